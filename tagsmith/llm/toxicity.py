"""Compression-distance toxicity: windows of a text compress better with a dictionary of toxic or of ordinary text.

Two zstandard dictionaries are made from labelled texts: dictionaries that zstandard's own trainer picks from the texts of each
class were tried first and separate the classes badly (see the README), as most of what they hold is common to both. Both begin with the same common words, so that they
serve ordinary language alike. The toxic one ends in the word forms and stems that toxic texts use far more often;
the ordinary one ends in the same forms with those stems replaced by common ordinary ones, so that their endings
help both alike. A window's evidence is its compressed length with the ordinary dictionary less that with the toxic
one, counted against thresholds; the counts are calibrated to a probability by a logistic fit on the same labelled
texts.

Everything learned comes from at most TRAIN_ROWS labelled texts (the first by a hash of the id; a documented bound of
the fit); scoring reads every whole text. Language, source, id and labels are never inputs of a score.

Defined cases: null or empty text is one empty window and gets the score of no evidence; without labelled texts of both classes
every score is the share of toxic labels (0 without any); repeated rows are scored each; other columns are kept or
ignored; an empty table gives an empty result. Windows are cut at spaces, or after 2 * WINDOW bytes where there are none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, staged, table

TRAIN_ROWS = 12_000
WINDOW = 40
#: A form is toxic if this share of toxic texts has it and its share is so many times that in ordinary texts, and if
#: MIN_TEXTS toxic texts have it (or MIN_FEW of them, where there are few).
MIN_SHARE, MIN_RATIO, MIN_TEXTS, MIN_FEW = 0.015, 30, 8, 0.15
COMMON_BYTES, FORM_BYTES = 60_000, 32_000
#: Least saving in bytes that counts as evidence, for the counting features.
STEPS = (3, 4, 5, 6, 8)

_WORD = re.compile(r"[^\W\d_]+")


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.update(" " + w[:k] for k in (4, 5, 6) if len(w) > k)
        if len(w) <= 24:
            out.add(" " + w)
    return out


def _term_rows(batches):
    for b in batches:
        for low in range(0, b.num_rows, 100):
            some = b.slice(low, 100)
            terms = [sorted(_terms(t or "")) for t in some.column(0).to_pylist()]
            n = [len(t) for t in terms]
            yield pa.RecordBatch.from_arrays([pa.array([x for t in terms for x in t], pa.string()), pa.array(np.repeat(some.column(1).to_numpy(), n), pa.int64())], ["term", "toxic"])


def _kin(batches):
    """Adds kin, the least hash of the text's three-word shingles: near copies nearly always share it."""
    from tagsmith.llm.jaccard_join import shingle_sets

    for b in batches:
        kin = np.zeros(b.num_rows, np.int64)
        for i, s in shingle_sets(b.column(0), 3):
            kin[i] = s[:1].view(np.int64)[0] if len(s) else 0
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kin)], ["text", "toxic", "kin"])


def _windows(text: str) -> list[bytes]:
    data, out, i = text.lower().encode("utf-8", "replace"), [], 0
    while i < len(data):
        j = data.find(b" ", i + WINDOW, i + 2 * WINDOW)
        j = min(len(data), i + 2 * WINDOW) if j < 0 else j
        out.append(data[i:j])
        i = j
    return out


def _compressor(dictionary: bytes):
    import zstandard as z

    raw = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
    how = z.ZstdCompressionParameters.from_level(3, source_size=256, dict_size=len(dictionary), min_match=6, strategy=z.STRATEGY_LAZY, window_log=17, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
    raw.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=raw, compression_params=how)


def _features(savings: list[int]) -> list[float]:
    d = np.array(savings or [0])
    top = np.sort(d)[::-1][:3]
    return [float(top[0]), float(top.sum()) / 3, float(np.log1p(np.maximum(d - 1, 0).sum())), *(float(np.log1p((d >= s).sum())) for s in STEPS), float(d.mean()), float(np.log1p(len(d)))]


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and the logistic fit; small, so it travels inside the tasks' closure."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        if not self.weights:
            return lambda text: self.prior
        measure = savings_of(self.toxic, self.ordinary)
        mean, scale, weights = np.array(self.mean), np.array(self.scale), np.array(self.weights)

        def score(text: str) -> float:
            x = (np.array(_features(measure(text))) - mean) / scale
            return float(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))

        return score


def savings_of(toxic: bytes, ordinary: bytes):
    """text -> for each window, the bytes that the toxic dictionary saves over the ordinary one."""
    t, o = _compressor(toxic), _compressor(ordinary)
    return lambda text: [len(o.compress(w)) - len(t.compress(w)) for w in _windows(text)]


def _dictionaries(counts: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[bytes, bytes]:
    share = F.col("toxic") / n_toxic
    forms = counts.where((share >= MIN_SHARE) & (F.col("toxic") >= max(4, min(MIN_TEXTS, MIN_FEW * n_toxic))) & (share >= MIN_RATIO * (F.col("ordinary") + 0.5) / n_ordinary))
    forms = [r["term"] for r in forms.orderBy(F.desc("toxic"), "term").limit(4_000).collect()]
    common = [r["term"] for r in counts.where("ordinary > 0 and length(term) > 3").orderBy(F.desc("ordinary"), "term").limit(14_000).collect()]
    known = set(forms)
    stem = {f: next((f[:k] for k in range(4, len(f)) if f[:k] in known), f) for f in forms}
    # the longest forms only: a form that begins another one is inside it
    ends, prefixes = [], set()
    for f in sorted(forms, key=len, reverse=True):
        if f not in prefixes:
            ends.append(f)
        prefixes.update(f[:k] for k in range(2, len(f) + 1))
    order = {f: i for i, f in enumerate(forms)}
    ends = sorted(ends, key=order.__getitem__, reverse=True)
    base = "".join(reversed(common)).encode()[-COMMON_BYTES:]
    toxic = "".join(ends).encode()[-FORM_BYTES:]
    instead = "".join(common[(700 + i) % len(common)][: len(stem[f])] + f[len(stem[f]) :] for i, f in enumerate(ends)).encode() if common else b""
    return base + toxic, base + instead[-FORM_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (p - y) + np.r_[0, w[1:]])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Train on the labelled texts of the ``rows`` smallest id hashes (texts of one id count together); near copies count once, or their own words would look toxic or ordinary."""
    texts = labelled.where(f"{label_col} is not null").select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("long").alias("toxic"), F.col(id_col).alias("id"))
    # the bound is found among hashes of ids; the texts stay in the tasks that read them
    cut = texts.select(F.xxhash64("id").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    texts = mapped(texts.where(F.xxhash64("id") <= F.lit(cut)).select("text", "toxic"), _kin, "text string, toxic long, kin long")
    texts = staged(texts.dropDuplicates(["kin"]).select("text", "toxic"), "toxic-train")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, ordinary = n.get(1, 0), n.get(0, 0)
    prior = toxic / max(1, toxic + ordinary)
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", (), (), (), prior)
    terms = mapped(texts, _term_rows, "term string, toxic long")
    counts = staged(terms.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary")).where("toxic + ordinary >= 4"), "toxic-terms")
    bad, good = _dictionaries(counts, toxic, ordinary)

    def rows_of(batches):
        measure = savings_of(bad, good)
        for b in batches:
            x = [_features(measure(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = mapped(texts.repartition(64), rows_of, "x array<double>, y long").toPandas()
    mean, scale, w = _logistic(np.array(got["x"].tolist()), got["y"].to_numpy(float))
    return ToxicityModel(bad, good, tuple(mean), tuple(scale), tuple(w), prior)


def with_score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text; all columns stay."""

    def run(batches):
        score = model.scorer()
        for b in batches:
            for low in range(0, b.num_rows, 500):
                some = b.slice(low, 500)
                texts = some.column(some.schema.get_field_index(text_col)).to_pylist()
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([score(t or "") for t in texts], pa.float64())], [*some.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructType

    return mapped(docs, run, StructType([*docs.schema.fields]).add(score_col, DoubleType()))


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def model_for(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model from the rows of labels that are not held out. The ids of its sample are at most TRAIN_ROWS rows, so they are broadcast."""
    sample = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    return fit_toxicity(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), label_col="__toxic")


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learned from labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = model_for(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = with_score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
