"""Benchmark decontamination by templates: finds benchmark items in documents, re-parameterised ones too.

Words become a template: numbers, names and units turn into typed placeholders, other words into lower case. Windows
of five template words are hashed and joined; the aligned windows of a document and an item (same offset) must fill
the item's slots consistently, i.e. each slot value of the item stands for one value throughout. An item is found
in a document if the consistent windows cover the stated share of its template words.

Windows of fewer than two literal words are keyed by their words, values included. An item with such windows is also found
where windows with its own words and values cover the share of all its words. Items of fewer than five words have one window of
their own length, joined the same way. A bit filter over the benchmark's window hashes, of bounded size, removes most
document windows before the join.

Defined cases: null or empty text matches nothing; an item of fewer than five words also matches a document whose whole
template it is; a window that repeats one word is verbatim evidence of nothing, so an item of one word, or of one word
repeated, is not found inside a longer text; repeated rows of an id count as one document;
other columns are ignored; an empty table on either side gives an empty result. All-capital words are not names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import BitFilter, bit_filter, mapped, mix64, staged, table
from tagsmith.llm.words import chunks, rolling, word_table

LITERAL, NUMBER, NAME, UNIT = range(4)
#: Kinds of window: keyed by template, a whole short text, keyed by its words.
TEMPLATE, WHOLE, VERBATIM = range(3)
#: Words that stand for numbers and for units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen twice double triple"
UNITS = "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometer kilometers kilometre kilometres g kg mg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons tonne tonnes ml l liter liters litre litres gallon gallons pint pints quart quarts second seconds sec minute minutes min hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent percentage degree degrees celsius fahrenheit kelvin mph kph watt watts volt volts ampere amperes joule joules newton newtons pascal pascals hertz hz byte bytes kb mb gb tb"
_SALT = mix64(np.array([0, 0xA1, 0xB2, 0xC3], np.uint64))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(word_table(data, np.array([0, len(data)]), _LETTER)[2])


_NUMBERS, _UNITS = _hash_words(NUMBERS.split()), _hash_words(UNITS.split())


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def template_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, word hash, owner) of each word of a run of texts."""
    ahead = np.append(data[1:], np.uint8(0))
    behind = np.append(np.uint8(0), data[:-1])
    digit = (data >= 48) & (data <= 57)
    letter = _LETTER[data]
    # general punctuation (E2 80 xx) and Latin-1 signs (C2 xx) separate words
    sign = (data == 0xE2) & (ahead == 0x80)
    letter[sign] = False
    for step in (1, 2):
        at = np.flatnonzero(sign) + step
        letter[at[at < len(data)]] = False
    sign = data == 0xC2
    letter[sign] = False
    at = np.flatnonzero(sign) + 1
    letter[at[at < len(data)]] = False
    # a point or comma inside a number belongs to it
    is_digit = np.append(digit, False)
    letter |= ((data == 46) | (data == 44)) & is_digit[np.arange(len(data)) - 1] & np.append(digit[1:], False) & (np.arange(len(data)) > 0)
    folded = _FOLD[data]
    latin = (behind == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    folded = np.where(latin, data | 0x20, folded)
    start, end, h, owner = word_table(np.where(letter, data, 32).astype(np.uint8), offsets, np.arange(256) != 32, None if not len(data) else folded)
    has_digit = np.append(0, np.cumsum(digit))
    stop = np.append(0, np.cumsum(np.isin(data, np.frombuffer(b".!?:;\n\"(", np.uint8)) & ~letter))
    upper = ((data >= 65) & (data <= 90)) | ((data == 0xC3) & (ahead >= 0x80) & (ahead <= 0x9E) & (ahead != 0x97))
    after_end = np.append(0, end[:-1]) if len(end) else end
    first = np.ones(len(start), bool)
    if len(start):
        first[1:] = (owner[1:] != owner[:-1]) | (stop[start[1:]] > stop[after_end[1:]])
    capital = upper[start] if len(start) else np.zeros(0, bool)
    shout = np.zeros(len(start), bool)
    longer = end - start > 1
    shout[longer] = upper[start[longer] + 1]
    kind = np.where(capital & ~first & ~shout, NAME, LITERAL)
    kind = np.where(_among(h, _UNITS), UNIT, kind)
    kind = np.where((has_digit[end] > has_digit[start]) | _among(h, _NUMBERS), NUMBER, kind)
    return kind, h, owner


def _varied(h: np.ndarray, m: int) -> np.ndarray:
    """Whether each m consecutive words are at least two different ones."""
    turns = np.append(0, np.cumsum(h[1:] != h[:-1]))
    return turns[m - 1 :] > turns[: len(h) - m + 1]


def _windows(texts: pa.Array, k: int, lengths: tuple[int, ...] | None):
    """For each text: (row, template words, places, hashes, k columns of slot values with 0 for literals, kinds of window).

    Windows of k words, keyed by template or, with fewer than two literals, by their words; a text of under k words whole;
    windows of the given lengths under k (None: of the text's own length), keyed likewise.
    """
    for first, end, data, offsets in chunks(texts):
        kind, h, owner = template_words(data, offsets)
        t = np.where(kind == LITERAL, h, _SALT[kind])
        bounds = np.searchsorted(owner, np.arange(end - first + 1))
        literal = np.append(0, np.cumsum(kind == LITERAL))
        value = np.where(kind == LITERAL, np.uint64(0), mix64(h ^ _SALT[kind]) | np.uint64(1))
        padded = np.append(value, np.zeros(k, np.uint64))
        made = {}
        for m in {k, *(range(1, k) if lengths is None else lengths)}:
            if len(t) >= m:
                salts = mix64(np.array([2 * m, 2 * m + 1], np.uint64))
                by_template = rolling(t, m) if m == k else mix64(rolling(t, m) ^ salts[0])
                bare = literal[m:] - literal[:-m] < 2
                made[m] = np.where(bare, mix64(rolling(h, m) ^ salts[1]), by_template), bare, ~bare | _varied(h, m)
        for i in range(end - first):
            a, b = int(bounds[i]), int(bounds[i + 1])
            n = b - a
            parts = [k] if n >= k else []
            parts += [m for m in ((n,) if lengths is None else lengths) if 0 < m < k and m <= n]
            place, w, values, kinds = [], [], [], []
            for m in parts:
                keys, bare, good = made[m]
                at = np.arange(a, b - m + 1)
                at = at[good[at]]
                place.append(at - a), w.append(keys[at]), kinds.append(np.where(bare[at], VERBATIM, TEMPLATE))
                values.append(padded[at[:, None] + np.arange(k)] * (np.arange(k) < m).astype(np.uint64))
            if 0 < n < k and literal[b] > literal[a]:
                place.append(np.zeros(1, np.int64)), w.append(rolling(np.append(t[a:b], np.uint64(n)), n + 1)), kinds.append(np.array([WHOLE]))
                values.append(np.append(value[a:b], np.zeros(k - n, np.uint64))[None, :])
            if place:
                yield first + i, n, np.concatenate(place), np.concatenate(w), np.concatenate(values), np.concatenate(kinds)


def template_windows(texts: pa.Array, k: int):
    """For each text: (row, template words, window places, window hashes, slot values) of the windows keyed by template."""
    for row, n, place, w, values, kinds in _windows(texts, k, ()):
        some = kinds != VERBATIM
        yield row, n, place[some], w[some], values[some]


def _rows(k: int, keep: BitFilter | None, lengths: tuple[int, ...] | None):
    """Rows (id, n words, place, w, slots, kind)."""

    def run(batches):
        for b in batches:
            ids = b.column(0)
            some, n, places, hashes, slots, kinds = [], [], [], [], [], []

            def out():
                lens = [len(p) for p in places]
                flat = np.concatenate(slots).view(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k, dtype=np.int32)), pa.array(flat))
                cols = [ids.take(pa.array(np.repeat(some, lens))), pa.array(np.repeat(n, lens), pa.int64()), pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(hashes).view(np.int64)), lists, pa.array(np.concatenate(kinds), pa.int64())]
                return pa.RecordBatch.from_arrays(cols, ["id", "n", "place", "w", "slots", "kind"])

            held = 0
            for i, words, place, w, values, kind in _windows(b.column(1), k, lengths):
                if keep is not None:
                    hit = keep.test(w)
                    place, w, values, kind = place[hit], w[hit], values[hit], kind[hit]
                if not len(w):
                    continue
                some.append(i), n.append(words), places.append(place), hashes.append(w), slots.append(values), kinds.append(kind)
                held += len(w)
                if held > 50_000:
                    yield out()
                    held = 0
                    for x in (some, n, places, hashes, slots, kinds):
                        x.clear()
            if some:
                yield out()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, share: float = 0.8, consistent: float = 0.8) -> DataFrame:
    """id_col, item_col, coverage, windows, slots, changed_slots: the items found in each document."""
    schema = "id long, n long, place long, w long, slots array<long>, kind long"
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null")
    items = staged(mapped(items, _rows(k, None, None), schema), "decontam-items")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    short = tuple(sorted(r["n"] for r in items.where(F.col("n") < k).select("n").distinct().collect()))  # under k of them
    windows = mapped(texts, _rows(k, bit_filter(items, "w"), short), schema)
    spread = F.transform(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(k)).cast("int") - 1), lambda j: F.col("place") + j)
    # verbatim evidence is that of an item's bare windows and of its other windows with the same values
    bare = items.where(F.col("kind") == VERBATIM).select(F.col("id").alias("item")).distinct().withColumn("bare", F.lit(True))
    theirs = items.select(F.col("id").alias("item"), F.col("n").alias("item_n"), F.col("place").alias("item_place"), "w", F.col("slots").alias("item_slots"), "kind").join(bare, "item", "left")
    modes = lambda same: F.explode(F.array_distinct(F.array_compact(F.array(F.col("kind"), F.when(F.col("bare") & (F.col("kind") == TEMPLATE) & same, F.lit(VERBATIM).cast("long"))))))
    words = theirs.withColumn("mode", modes(F.lit(True))).withColumn("word", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.col("item_n"), F.lit(k)).cast("int") - 1), lambda j: F.col("item_place") + j))).groupBy("item", "mode").agg(F.count_distinct("word").alias("words"))
    met = windows.drop("kind", "n").join(theirs, "w").withColumn("mode", modes(F.col("slots") == F.col("item_slots")))
    filled = F.filter(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(F.get("item_slots", j).alias("v"), F.get("slots", j).alias("u"))), lambda s: s["v"] != 0)
    met = met.select("id", "item", "mode", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", F.least("item_n", F.lit(k)).alias("span"), filled.alias("filled"))
    # one row for each alignment: at most as many places as the item has
    runs = met.groupBy("id", "item", "mode", "shift").agg(F.collect_set("item_place").alias("places"), F.max("span").alias("span"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"))
    kinds = F.size(F.array_distinct(F.transform("filled", lambda s: s["v"])))
    runs = runs.withColumns({"slots": F.size("filled"), "kinds": kinds, "changed": F.size(F.filter("filled", lambda s: s["v"] != s["u"]))})
    runs = runs.where(F.col("kinds") >= consistent * F.col("slots"))
    covered = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), F.col("span").cast("int") - 1), lambda j: p + j)))
    runs = runs.withColumn("covered", F.array_distinct(covered))
    found = runs.groupBy("id", "item", "mode").agg(F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).alias("covered"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("windows"), F.sum("kinds").alias("slots"), F.sum("changed").alias("changed_slots"))
    found = found.join(words, ["item", "mode"]).withColumn("coverage", F.col("covered") / F.col("words")).where(F.col("coverage") >= share)
    best = F.max_by(F.struct("coverage", "windows", "slots", "changed_slots"), F.struct("coverage", -F.col("mode")))
    found = found.groupBy("id", "item").agg(best.alias("b")).select("id", "item", "b.*")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "coverage", "windows", "slots", "changed_slots")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
