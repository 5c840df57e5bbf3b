"""The whole way from engines' raw tokens to a label's text: which calls are made, which one wins, and what becomes of its words.

Candidates of one table, a row a token, are scored by call; the best page mode wins within a variant, the best variant within an
engine, the first engine with words the label. Only keys and scores take part in that; the winner's words are then fetched
by their key, mapped to the source image, put into lines and joined to text. Tokens are written once as words; what is shuffled
are counts by call and the winners' words, unless the winners are too many to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.functions.text import squeeze
from tagsmith.operators import ocr
from tagsmith.settings import DEFAULT
from tagsmith.sources.shared import kept

CALL = ("engine", "variant_ord", "psm_ord")
#: Winners are broadcast up to so many bytes; about what one takes.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 128
#: The preprocessed images that are tried, in order.
VARIANTS = ("original", "gray", "clahe", "adaptive")


@dataclass(frozen=True)
class OcrSettings:
    """psm: the configured page mode; hosted: the second engine alone, its first variant with words; second: the second engine beside the first."""

    psm: int = DEFAULT.psm
    hosted: bool = False
    second: bool = False
    floor: float = DEFAULT.ocr_floor

    def __post_init__(self):
        if self.psm < 0 or not 0 <= self.floor <= 100:
            raise ValueError("psm must not be negative, floor must be from 0 to 100")

    def psms(self) -> list[int]:
        """The page modes of a variant: the configured one, and 6 beside another."""
        return [self.psm] if self.hosted or self.psm == 6 else [self.psm, 6]

    def calls(self) -> list[tuple[str, int, int, int | None]]:
        """(engine, variant_ord, psm_ord, psm) of every call of a label."""
        first = [] if self.hosted else [("tesseract", v, p, psm) for v in range(len(VARIANTS)) for p, psm in enumerate(self.psms())]
        second = [("easyocr", v, 0, None) for v in range(len(VARIANTS) if self.hosted else 1)] if self.hosted or self.second else []
        return first + second


def planned_calls(labels: DataFrame, settings: OcrSettings, key: str = "label_id") -> DataFrame:
    """key, engine, variant_ord, psm_ord, psm, variant: the calls that an OCR connector has to make."""
    call = lambda e, v, p, psm: F.struct(F.lit(e).alias("engine"), F.lit(v).alias("variant_ord"), F.lit(p).alias("psm_ord"), F.lit(psm).cast("int").alias("psm"), F.lit(VARIANTS[v]).alias("variant"))
    return labels.select(key, F.inline(F.array(*[call(*c) for c in settings.calls()])))


def _planned(settings: OcrSettings) -> Column:
    """Whether a row's call is one of the plan."""
    wanted = F.lit(False)
    for engine in ("tesseract", "easyocr"):
        mine = [c for c in settings.calls() if c[0] == engine]
        if mine:
            wanted = wanted | ((F.col("engine") == engine) & F.col("variant_ord").isin(sorted({c[1] for c in mine})) & F.col("psm_ord").isin(sorted({c[2] for c in mine})))
    return wanted


def usable_words(tokens: DataFrame, settings: OcrSettings) -> DataFrame:
    """Tokens of both engines (all values text; the second engine's confidence is a fraction) as words of planned calls; blank ones go, and the second engine's under the floor."""
    second = F.col("engine") == "easyocr"
    rows = ocr.clean_words(tokens.where(_planned(settings)).withColumn("confidence", F.when(second, (F.col("confidence").try_cast("double") * 100).cast("string")).otherwise(F.col("confidence"))))
    return rows.where(~second | (F.col("confidence") >= settings.floor))


def call_scores(words: DataFrame, key: str = "label_id") -> DataFrame:
    """key, engine, variant_ord, psm_ord, n_words, confidence, score of the calls that have words."""
    plain, positive = F.avg("confidence"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence")))
    letters = F.sum(F.regexp_count("text", F.lit("[A-Za-z0-9]")))
    rows = words.groupBy(key, *CALL).agg(F.count(F.lit(1)).alias("n_words"), letters.alias("__letters"), F.coalesce(F.round(F.when(F.first("engine") == "easyocr", plain).otherwise(positive), 2), F.lit(0.0)).alias("confidence"))
    score = F.col("confidence") + F.least(F.col("__letters") / 20.0, F.lit(10.0)) + F.least(F.col("n_words") / 10.0, F.lit(5.0))
    return rows.withColumn("score", score).drop("__letters")


def tournament(scores: DataFrame, settings: OcrSettings, key: str = "label_id") -> DataFrame:
    """key, tesseract, easyocr: the winning call of each engine, a struct or null. The highest score wins, the first of equals;
    where the plan stops at the first variant with words, the first variant does.
    """
    best = lambda *by: F.max_by(F.struct("variant_ord", "psm_ord", "n_words", "confidence", "score"), F.struct(*by))
    per_variant = scores.groupBy(key, "engine", "variant_ord").agg(best("score", -F.col("psm_ord")).alias("c")).select(key, "engine", "c.*")
    order = (-F.col("variant_ord"),) if settings.hosted else (F.col("score"), -F.col("variant_ord"))
    per_engine = per_variant.groupBy(key, "engine").agg(best(*order).alias("c"))
    of = lambda e: F.any_value(F.when(F.col("engine") == e, F.col("c")), True).alias(e)
    return per_engine.groupBy(key).agg(of("tesseract"), of("easyocr"))


def choose(images: DataFrame, winners: DataFrame, key: str = "label_id") -> DataFrame:
    """images with engine, variant_ord, psm_ord and confidence: the first engine with words, else the second; every image has a row.

    The confidence is the mean of the engines' positive ones, one place; 0 without any.
    """
    rows = images.join(winners, key, "left")
    won = F.coalesce("tesseract", "easyocr")
    seen = F.filter(F.array("tesseract.confidence", "easyocr.confidence"), lambda c: c > 0)
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, c: s + c) / F.size(seen)).otherwise(0.0)
    return rows.select(*images.columns, F.when(F.col("tesseract").isNotNull(), "tesseract").otherwise("easyocr").alias("engine"), won["variant_ord"].alias("variant_ord"), won["psm_ord"].alias("psm_ord"), F.bround(mean, 1).alias("confidence"))


def placed_words(words: DataFrame, chosen: DataFrame, key: str = "label_id", limit: int = BROADCAST_BYTES) -> DataFrame:
    """key, seq, text, confidence, x, y, w, h, line_index, word_index of the winners' words, in source coordinates.

    Winners (a row a label) of up to limit bytes are broadcast, so that words of losing calls are not shuffled.

    The first engine's lines are its own; the second has none, so its words are put into lines by their height.
    """
    call = chosen.select(key, *[F.col(c).alias(f"__{c}") for c in CALL], "ocr_w", "ocr_h", "image_w", "image_h")
    call = F.broadcast(call) if call.count() * ROW_BYTES <= limit else call
    won = words.join(call, key).where(" AND ".join(f"{c} = __{c}" for c in CALL))
    won = ocr.map_boxes(won, F.greatest("ocr_w", F.lit(1)), F.greatest("ocr_h", F.lit(1)), F.col("image_w"), F.col("image_h"))
    won = won.select(key, "engine", "seq", "text", "confidence", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("ow").alias("w"), F.col("oh").alias("h"), *ocr.LINE)
    first = ocr.index_words(won.where("engine = 'tesseract'"), key)
    second = won.where("engine = 'easyocr'")
    lines = ocr.cluster_words(second, key).select(key, "line_index", F.posexplode("words").alias("word_index", "o")).select(key, F.col("o.seq").alias("seq"), "line_index", "word_index")
    cols = (key, "seq", "text", "confidence", "x", "y", "w", "h", "line_index", "word_index")
    return first.select(*cols).unionByName(second.join(lines, [key, "seq"]).select(*cols))


def label_texts(chosen: DataFrame, placed: DataFrame, key: str = "label_id") -> DataFrame:
    """chosen with n_words, n_lines and text: lines in order, words of a line left to right; "" and zeros without words."""
    ordered = F.array_sort(F.collect_list(F.struct("word_index", "text")))
    lines = placed.groupBy(key, "line_index").agg(F.count(F.lit(1)).alias("n"), squeeze(F.array_join(F.transform(ordered, lambda o: o["text"]), " ")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line"))), lambda o: o["line"]), "\n")
    texts = lines.where("line <> ''").groupBy(key).agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_lines"), text.alias("text"))
    return chosen.join(texts, key, "left").na.fill({"n_words": 0, "n_lines": 0, "text": ""})


def failures(calls: DataFrame, settings: OcrSettings, key: str = "label_id") -> DataFrame:
    """key, error: why a label's planned calls gave nothing, the first call's message first; labels with an available call have none."""
    rows = calls.where(_planned(settings))
    order = F.struct((F.col("engine") != "tesseract").alias("second"), "variant_ord", "psm_ord")
    rows = rows.groupBy(key).agg(F.max("available").alias("available"), F.min_by(F.coalesce("error", F.lit("not available")), order).alias("error"))
    return rows.where("not available").select(key, "error")


def read_labels_by_plan(images: DataFrame, calls: DataFrame, tokens: DataFrame, settings: OcrSettings | None = None, key: str = "label_id", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(labels, words) of images (key, image_w, image_h, ocr_w, ocr_h), calls (key, engine, variant_ord, psm_ord, available, error) and their tokens.

    labels: key, engine, variant_ord, psm_ord, confidence, n_words, n_lines, text, error (null where a call was available);
    words: see placed_words. Tokens of calls that are not available, or not of the plan, do not count.
    """
    settings = settings or OcrSettings()
    words = usable_words(tokens, settings).select(key, *CALL, "seq", "text", "confidence", "x", "y", "w", "h", *ocr.LINE)
    words = kept(words, "ocr-words")
    scores = call_scores(words, key).join(calls.where("available").select(key, *CALL), [key, *CALL], "left_semi")
    chosen = kept(choose(images, tournament(scores, settings, key), key), "ocr-chosen")
    placed = placed_words(words, chosen, key, limit)
    labels = label_texts(chosen, placed, key).join(failures(calls, settings, key), key, "left")
    return labels.select(key, "engine", "variant_ord", "psm_ord", "confidence", "n_words", "n_lines", "text", "error"), placed
