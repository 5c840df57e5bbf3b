"""N-gram Jaccard join in the Jaccard metric space, exact, one row per document.

d(x, y) = 1 - |x & y| / |x | y| is a metric on sets; two documents link when d <= r (r = 0.1 by default).

1. Regions. Unrelated texts lie at distances of 0.97 to 1 from every document, so with documents alone as
   pivots every window of 2r would admit every pivot. The first pivots are therefore the shingles, from the rarest to
   the most frequent (levels of how many documents hold one, then the hash): a set lies in the region of its first
   shingle, and its window of r replicates it to the regions of the next ones. Of a set of n, a linked set holds at
   least ceil(n (1 - r)), so the first shingle that two linked sets share is among the first n - ceil(n (1 - r)) + 1
   of either one, and they meet in its region. Shingles of one document take places but make no region.
2. Pivots. Each cell's pivot document p is its member in the densest cells; all members are measured against it and
   near ones link to it. Before any set is fetched, a pair is held against the triangle inequality in a smaller metric
   space: the parity sketch of a set (how many of its elements fall on each of B bits, modulo 2) lies no further
   from another's than the sets do, so a pair further apart there than linked sets may be is left out.
3. Recursion. A cell whose members are one component is finished: more links there change nothing. Of a small open cell
   the pairs from different components are measured. Of a large open one the members form the region of p, a member of
   several cells being replicated to each one's region, and the join is repeated on the difference sets D(x) = x ^ p,
   which keep all distances: x ^ y = D(x) ^ D(y). If D(x) and D(y) are disjoint, then x & y is inside p and p inside
   x | y, so d(x, p) <= d(x, y): a linked pair is then linked to p already. Any other linked pair has |x ^ y| <= h, so
   of the smaller difference set at most h / 2 elements and of the larger at most h are not shared (triangle
   inequality): the first common element, in any order, is among the first h / 2 + 1 and h + 1. The order puts what p
   lacks first: many members lack the same shingle of p, few add the same one. The members that hold such an
   element are the cells of the next level. If the pairs that these cells allow at most are within the bound below, the
   members meet by the places of the element in their difference sets; else the join recurs with the cells' own pivots.

Nothing is capped or compared approximately; sets are sets of 64-bit shingle hashes. Division ends where the open cells
allow no more pairs than PAIRS_PER_ROW times the rows of the first cells and PAIRS_PER_DOCUMENT times the documents, so
pairs grow like the input, or after LEVELS divisions; the pairs from different components that are left are measured all.

Defined cases: null, empty or blank text has the empty set, n_shingles 0, and is linked with nothing; a text of fewer
than k words has its whole word sequence as its one shingle; identical sets are one class, represented by the
smallest id; of rows that repeat an id, the one with the smallest text counts; a row without an id cannot be named in a
result and is left out (callers that must decide on such rows give them keys, see ``with_row_keys``); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import BitFilter, arrow_batches, attach, bit_filter, components, drop_staged, hot_keys, join_unique, mapped, mix64, staged, table
from tagsmith.llm.words import chunks, rolling, word_table

#: Shingles are ordered by how many of these counts of documents they reach; each level is one bit filter.
LEVEL_COUNTS = (2, 8, 64)
#: They are counted in buckets of about so many, from sorted runs of about so many of a task's documents.
BUCKET_SHINGLES, RUN_SHINGLES = 1 << 20, 1 << 20
#: Cells of at most this many members are joined pair by pair, larger ones are divided, at most LEVELS times.
SMALL, LEVELS = 16, 6
#: Division ends where all open cells together have at most so many pairs for each row of the first cells and each document.
PAIRS_PER_ROW, PAIRS_PER_DOCUMENT = 1, 8
#: Rows of texts and sets that are passed to Python at once.
BATCH_ROWS = 2000
#: Pivots' sets of at most so many bytes, by their counted sizes, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 16 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of an Arrow array."""
    for first, end, data, offsets in chunks(texts):
        _, _, h, owner = word_table(data, offsets, _WORD, _FOLD)
        bounds = np.searchsorted(owner, np.arange(end - first + 1))
        grams = rolling(h, k) if len(h) >= k else h[:0]
        for i in range(end - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield first + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                short = rolling(np.append(h[a:b], np.uint64(b - a)), b - a + 1)  # the length keeps it apart from whole shingles
                yield first + i, short
            else:
                yield first + i, h[:0]


def leading(s: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles in whose regions a set lies, s sorted, levels of its shingles; those of level 0 are no one else's."""
    take = len(s) - -(-len(s) * num // den) + 1
    place = (levels.astype(np.uint64) << np.uint64(62)) | (mix64(s) >> np.uint64(2))
    first = np.argsort(place, kind="stable")[:take]
    return s[first[levels[first] > 0]]


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix64(mix64(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))
        b = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def sketch_longs(n: int, num: int, den: int) -> int:
    """Size of the parity sketch of a set of n: at least four bits for each element by which a linked set may differ."""
    need = max(8, -(-n * (den - num) // num // 16))
    return 1 << (need - 1).bit_length()


def parity_sketch(s: np.ndarray, longs: int) -> np.ndarray:
    """How many elements fall on each bit, modulo 2; a sketch of half the size is the xor of its halves."""
    place = (mix64(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(64 * longs - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _classes(k: int, num: int, den: int):
    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 2000):
                some = b.slice(low, 2000)
                n = np.zeros(some.num_rows, np.int64)
                f = np.zeros((2, some.num_rows), np.int64)
                sketches: list[np.ndarray] = []
                for i, s in shingle_sets(some.column(1), k):
                    n[i], (f[0, i], f[1, i]) = len(s), _fingerprint(s)
                    sketches.append(parity_sketch(s, sketch_longs(len(s), num, den)) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0] + [len(x) for x in sketches]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(f[0]), pa.array(f[1]), lists], ["row", "n", "f1", "f2", "sketch"])

    return run


def _shingle_runs(k: int, buckets: int):
    """Rows (bucket, run): sorted 32 bits of the shingles' hashes, enough for the levels' filters, by ranges of them.

    A run holds what some documents hold of its range: a shingle once for each of them, but not oftener than the last level asks.
    """
    most = LEVEL_COUNTS[-1]
    bounds = np.array([-(-(b << 32) // buckets) for b in range(buckets + 1)], np.uint64)

    def run(batches):
        held, size = [], 0

        def out():
            h = np.concatenate(held)
            held.clear()
            h.sort()
            again = np.flatnonzero(h[most:] == h[:-most]) + most
            if len(again):
                h = np.delete(h, again)
            ends = np.searchsorted(h, bounds)
            some = np.flatnonzero(np.diff(ends))
            places = np.append(ends[some], len(h)).astype(np.int32) * h.itemsize
            runs = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(places), pa.py_buffer(h)])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), runs], ["bucket", "run"])

        for b in batches:
            for _, s in shingle_sets(b.column(1), k):
                held.append(s.astype(np.uint32))
                size += len(s)
                if size > RUN_SHINGLES:
                    yield out()
                    size = 0
        if size:
            yield out()

    return run


def _counted(bucket: pa.Table) -> pa.Table:
    """Rows (cell, count) of a bucket's shingles that as many documents hold as the first level asks; counts beyond the last level are not whole."""
    h = np.frombuffer(b"".join(bucket.column("run").to_pylist()), np.uint32)
    h, n = np.unique(h, return_counts=True)
    keep = n >= LEVEL_COUNTS[0]
    return pa.table({"cell": pa.array(h[keep].view(np.int32)), "count": pa.array(n[keep])})


def _cells(k: int, num: int, den: int, filters: list[BitFilter]):
    """Rows (cell, f1, f2, x): the regions in which each document lies."""

    def run(batches):
        for b in batches:
            ids = _ids(b)
            cells, rows, f1, f2 = [], [], [], []
            held = 0

            def out():
                n = np.array([len(c) for c in cells])
                cols = [pa.array(np.concatenate(cells).view(np.int64)), *(pa.array(np.repeat(np.array(f, np.int64), n)) for f in (f1, f2)), pa.array(np.repeat(ids[rows], n))]
                return pa.RecordBatch.from_arrays(cols, ["cell", "f1", "f2", "x"])

            for i, s in shingle_sets(b.column(1), k):
                if not len(s):
                    continue
                levels = np.zeros(len(s), np.uint8)
                for f in filters:
                    levels += f.test(s)
                keys = leading(s, levels, num, den)
                if not len(keys):
                    continue
                a, c = _fingerprint(s)
                cells.append(keys), rows.append(i), f1.append(a), f2.append(c)
                held += len(keys)
                if held > 200_000:
                    yield out()
                    held = 0
                    for x in (cells, rows, f1, f2):
                        x.clear()
            if cells:
                yield out()

    return run


def _sets(k: int, keep: BitFilter, names: list[str]):
    """Rows (row, shingles), under the given names, of the documents that may be in keep."""

    def run(batches):
        for b in batches:
            ids = _ids(b)
            wanted = np.flatnonzero(keep.test(mix64(ids.view(np.uint64))))
            for at in range(0, len(wanted), 256):
                some = wanted[at : at + 256]
                sets = [s for _, s in shingle_sets(b.column(1).take(pa.array(some)), k)]
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), lists], names)

    return run


def _near(sizes: str, apart: str, num: int, den: int) -> str:
    """Whether two sets of these sizes (a sum) that differ in so many elements are similar enough: exact in integers.

    both = (sizes - apart) / 2, either = (sizes + apart) / 2.
    """
    return f"({sizes} - {apart}) * {den} >= ({sizes} + {apart}) * {num}"


def sketches_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits by which two sketches differ, the larger one folded to the smaller: never more than the sets differ by."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) ^ b).sum())


def _close(num: int, den: int):
    """Rows (x, y, nx, ny, sx, sy) -> (x, y) of those whose sketches are as near as linked sets' are."""

    def run(batches):
        for b in batches:
            nx, ny = (b.column(i).to_numpy() for i in (2, 3))
            (va, sa), (vb, sb) = ((c.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(c.value_lengths().to_numpy()))) for c in (b.column(4), b.column(5)))
            apart = np.array([sketches_apart(va[sa[i] : sa[i + 1]], vb[sb[i] : sb[i + 1]]) for i in range(b.num_rows)], np.int64)
            keep = pa.array((nx + ny - apart) * den >= (nx + ny + apart) * num)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["x", "y"])

    return run


class _Join:
    """The join's parameters and the tables that all of its levels read."""

    def __init__(self, docs: DataFrame, info: DataFrame, k: int, num: int, den: int):
        self.docs, self.info, self.k, self.num, self.den = docs, info, k, num, den

    def sizes_fit(self, a: str, b: str) -> str:
        return f"least({a}, {b}) * {self.den} >= greatest({a}, {b}) * {self.num}"

    def close(self, pairs: DataFrame, hot: list[int]) -> DataFrame:
        """Of the pairs (x, y), those that the sketches do not rule out; a written table. hot: the y of very many pairs."""
        for c, keys in (("x", []), ("y", hot)):
            pairs = join_unique(pairs, self.info.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c, keys)
        pairs = pairs.where(self.sizes_fit("nx", "ny")).select("x", "y", "nx", "ny", "sx", "sy")
        return staged(mapped(pairs, _close(self.num, self.den), "x long, y long"), "jaccard-close")

    def sets(self, ids: DataFrame, c: str, rows: int) -> DataFrame:
        """c, s<c>: shingles of the documents of ids (at most so many rows), and of a few more that the filter lets through."""
        keep = bit_filter(mapped(ids, _hash_ids, "h long"), "h", rows)
        return mapped(self.docs, _sets(self.k, keep, [c, f"s{c}"]), f"{c} long, s{c} array<long>")

    def with_sets(self, pairs: DataFrame, rows: int, hot: list[int]) -> DataFrame:
        """The pairs (x, y, ...) with their shingles sx and sy; pairs is a written table of so many rows, y its side of fewer documents."""
        ys = staged(pairs.select("y").distinct().join(self.info.select(F.col("row").alias("y"), "n"), "y"), "jaccard-ids")
        held, size = ys.agg(F.count("y"), F.sum("n")).first()
        of_y = self.sets(ys.select("y"), "y", held)
        both = join_unique(pairs, self.sets(pairs.select("x").distinct(), "x", rows), "x", [])
        if 8 * (size or 0) <= BROADCAST_BYTES:
            return both.join(F.broadcast(of_y.join(ys.select("y"), "y", "left_semi")), "y")
        return join_unique(both, of_y, "y", hot)

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """Of the pairs (x, y), the linked ones as (a, b); a written table, or None if there are none to measure."""
        pairs = staged(pairs.select("x", "y").distinct(), "jaccard-pairs")
        hot = hot_keys(pairs, "y", pairs.count())
        close = self.close(pairs, hot)
        drop_staged(pairs)
        rows = close.count()
        if not rows:
            return None
        sizes, common = F.expr("size(sx) + size(sy)"), F.expr("size(array_intersect(sx, sy))")
        got = self.with_sets(close, rows, hot).select("x", "y", sizes.alias("sizes"), (sizes - 2 * common).alias("apart"))
        out = staged(got.where(_near("sizes", "apart", self.num, self.den)).select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-links")
        drop_staged(close)
        return out

    def with_pivots(self, members: DataFrame) -> DataFrame:
        """cell, x, p of the members (cell, x), a written table; of cells with the same members one stands for all."""
        same = [F.bit_xor(F.xxhash64("x", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
        cells = members.groupBy("cell").agg(F.count("x").alias("size"), *same).where("size > 1")
        cells = cells.groupBy("size", "s1", "s2").agg(F.min("cell").alias("cell")).select("cell", "size")
        rows = staged(members.join(cells, "cell"), "jaccard-cells")
        score = rows.groupBy("x").agg(F.sum("size").alias("score"))
        rank = F.shiftleft(F.col("score"), 16).bitwiseOR(F.xxhash64("x").bitwiseAND(F.lit(0xFFFF)))
        pivots = rows.join(score, "x").groupBy("cell").agg(F.max_by("x", rank).alias("p"))
        out = staged(rows.select("cell", "x").join(pivots, "cell").where("x <> p"), "jaccard-regions")
        drop_staged(rows)
        return out

    def open_cells(self, regions: DataFrame, labels: DataFrame | None) -> DataFrame:
        """cell, x, p, n, c (component), members of the cells that are not one component yet; a written table."""
        tag = regions.join(self.info.select(F.col("row").alias("x"), "n"), "x").withColumn("c", F.col("x"))
        if labels is not None:
            tag = tag.join(labels.select(F.col("node").alias("x"), "component"), "x", "left").withColumn("c", F.coalesce("component", "c"))
        tag = staged(tag.select("cell", "x", "p", "n", "c"), "jaccard-tagged")
        shape = tag.groupBy("cell").agg(F.count("x").alias("members"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
        out = staged(tag.join(shape.select("cell", "members"), "cell"), "jaccard-open")
        drop_staged(tag)
        return out

    def cross_pairs(self, cells: DataFrame) -> DataFrame:
        """(x, y) of the cells' members in different components."""
        a, b = cells.select("cell", "x", "n", "c").alias("a"), cells.select("cell", "x", "n", "c").alias("b")
        met = a.join(b, (F.col("a.cell") == F.col("b.cell")) & F.expr(f"a.x < b.x and a.c <> b.c and {self.sizes_fit('a.n', 'b.n')}"))
        return met.select("a.x", F.col("b.x").alias("y"))

    def placed_pairs(self, held: DataFrame) -> DataFrame:
        """(x, y) of the holders (cell, x, n, c, d, place) in different components whose places allow a link.

        Nothing before the first common element is shared, and of |x ^ y| <= h elements (h + d(x) - d(y)) / 2 are x's.
        """
        cols = ["cell", "x", "n", "c", "d", "place"]
        a, b = held.where("leads").select(*cols).alias("a"), held.select(*cols).alias("b")
        h = f"((a.n + b.n) * {self.den - self.num} div {self.den + self.num})"
        # the smaller difference set leads; of two that are as large, the smaller row
        roles = "(a.d < b.d or a.d = b.d and a.x < b.x) and a.c <> b.c"
        places = f"2 * a.place <= {h} + a.d - b.d and 2 * b.place <= {h} + b.d - a.d"
        met = a.join(b, (F.col("a.cell") == F.col("b.cell")) & F.expr(f"{roles} and {places} and {self.sizes_fit('a.n', 'b.n')}"))
        return met.select(F.least("a.x", "b.x").alias("x"), F.greatest("a.x", "b.x").alias("y"))

    def divided(self, large: DataFrame) -> DataFrame:
        """Cells of the next level: members of a pivot's region by the leading elements of their difference sets.

        cell, x, n, c, d (size of the difference set), place (of the element in it), leads, members; a written table.
        """
        num, den = self.num, self.den
        pairs = staged(large.select("x", F.col("p").alias("y"), "n", "c").distinct(), "jaccard-regions")
        rows = pairs.count()
        far = self.with_sets(pairs, rows, hot_keys(pairs, "y", rows))
        far = far.select("x", "y", "n", "c", F.concat(F.array_sort(F.array_except("sx", "sy")), F.array_sort(F.array_except("sy", "sx"))).alias("diff"))
        # of two linked sets, each has at most n (den - num) / num elements of their symmetric difference to spare
        h = f"(n * {den - num} div {num})"
        far = far.select(F.col("y").alias("p"), "x", F.expr(h).alias("h"), F.expr(f"slice(diff, 1, cast({h} + 1 as int))").alias("first"), "n", "c", F.size("diff").cast("long").alias("d"))
        far = staged(far, "jaccard-far")
        # counted by 32 bits of a cell's hash, enough for the filter; cells are told apart whole below
        shared = mapped(far, _elements(), "cell int, leads boolean").groupBy("cell").agg(F.count("leads").alias("holders"), F.max("leads").alias("leads"))
        shared = staged(shared.where("holders > 1 and leads").select("cell"), "jaccard-shared")
        held = mapped(far, _elements(bit_filter(shared, "cell")), "cell long, x long, n long, c long, d long, place long, leads boolean")
        held = staged(held, "jaccard-held")
        shape = held.groupBy("cell").agg(F.count("x").alias("members"), F.max("leads").alias("led"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        out = staged(held.join(shape.where("lo <> hi and led").select("cell", "members"), "cell"), "jaccard-members")
        drop_staged(pairs, far, shared, held)
        return out


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Link documents whose k-word shingle sets have a Jaccard similarity of num / den or more.

    Returns id_col, n_shingles, component_id: the smallest id that links reach, the document's own included.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text")).where("row is not null")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):  # all Python runs in here; the result only reads written tables
        return _joined(docs, id_col, k, num, den)


def _joined(docs: DataFrame, id_col: str, k: int, num: int, den: int) -> DataFrame:
    if docs.groupBy("row").count().where("count > 1").limit(1).count():  # only the ids are shuffled to see this
        docs = staged(docs.groupBy("row").agg(F.min("text").alias("text")), "jaccard-docs")
    info = staged(mapped(docs, _classes(k, num, den), "row long, n long, f1 long, f2 long, sketch array<long>"), "jaccard-classes")

    join = _Join(docs, info, k, num, den)

    # a row a shingle would fill the executors' hash tables with shingles that one document holds, so they are shuffled as runs
    shingles = info.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingles // BUCKET_SHINGLES)
    runs = mapped(docs, _shingle_runs(k, buckets), "bucket int, run binary")
    counts = staged(runs.groupBy("bucket").applyInArrow(_counted, "cell int, count long"), "jaccard-counts")
    reach = counts.agg(*(F.count_if(F.col("count") >= c) for c in LEVEL_COUNTS)).first()
    filters = [bit_filter(counts.where(F.col("count") >= c), "cell", r) for c, r in zip(LEVEL_COUNTS, reach, strict=True)]
    rows = mapped(docs, _cells(k, num, den, filters), "cell long, f1 long, f2 long, x long")
    members = staged(rows.groupBy("cell", "f1", "f2").agg(F.min("x").alias("x")).select("cell", "x"), "jaccard-members")
    drop_staged(counts)

    budget = PAIRS_PER_ROW * members.count() + PAIRS_PER_DOCUMENT * info.count()
    labels, level, last = None, 0, []
    while True:
        regions = join.with_pivots(members)
        drop_staged(members)
        labels = _relabelled(labels, join.links(regions.select("x", F.col("p").alias("y"))))
        opened = join.open_cells(regions, labels)
        drop_staged(regions)
        pairs = (opened.agg(F.sum(F.col("members") - 1)).first()[0] or 0) // 2
        if pairs <= budget:
            last.append(staged(join.cross_pairs(opened), "jaccard-open"))
            drop_staged(opened)
            break
        last.append(staged(join.cross_pairs(opened.where(F.col("members") <= SMALL)), "jaccard-open"))
        members = join.divided(opened.where(F.col("members") > SMALL))
        drop_staged(opened)
        level += 1
        pairs = members.where("leads").agg(F.sum(F.col("members") - 1)).first()[0] or 0
        if pairs <= budget or level == LEVELS:
            last.append(staged(join.placed_pairs(members), "jaccard-open"))
            drop_staged(members)
            break
    labels = _relabelled(labels, join.links(reduce(DataFrame.union, last)))
    drop_staged(*last)

    reps = info.where("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("x"), F.count("row").alias("copies"))
    if labels is None:
        reps = reps.withColumnRenamed("x", "component")
    else:
        reps = reps.join(labels, reps["x"] == labels["node"], "left").select("f1", "f2", F.coalesce("component", "x").alias("component"), "copies")
    out = attach(info.select("row", "n", "f1", "f2"), reps, ["f1", "f2"], "copies", info.count())
    return out.select(F.col("row").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "row").alias("component_id"))


def _relabelled(old: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """Labels (node, component) of the links and of what the old labels joined."""
    if links is None:
        return old
    edges = links
    if old is not None:
        edges = links.union(old.where("node <> component").select("node", "component"))
    out = components(edges, "jaccard")
    drop_staged(links, *([old] if old is not None else []))
    return out


def _hash_ids(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix64(_ids(b).view(np.uint64)).view(np.int64))], ["h"])


def _elements(keep: BitFilter | None = None):
    """Rows (p, x, h, first, n, c, d) -> (cell, leads) of each element, or with keep, (cell, x, n, c, d, place, leads) of those that may be in it.

    leads: whether the element is among those that a smaller difference set must share.
    """

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                some = b.slice(low, 1000)
                lists = some.column(3)
                e = lists.flatten().to_numpy(zero_copy_only=False)
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(some.num_rows), size)
                p, x, h, n, c, d = (some.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5, 6))
                cell = mix64(mix64(e.view(np.uint64)) ^ p[row].view(np.uint64))
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                leads = place <= h[row] // 2
                if keep is None:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64).astype(np.int32)), pa.array(leads)], ["cell", "leads"])
                    continue
                at = keep.test(cell)
                cols = [cell[at].view(np.int64), *(v[row[at]] for v in (x, n, c, d)), place[at], leads[at]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["cell", "x", "n", "c", "d", "place", "leads"])

    return run


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, similarity 0.9 or more, over the whole of documents."""
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, num=9, den=10)
