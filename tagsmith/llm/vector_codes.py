"""Product codes of vectors by Yinyang Lloyd: entries in groups, one lower bound a group, integer distances.

A vector becomes integers and is cut into equal parts; each part's codebook begins as that part of the first vectors by id and
goes through rounds of Lloyd's algorithm. The entries of a codebook are put into groups once. Every vector carries, for each
part and group, a lower bound of the distance to the group's entries other than its own. Between rounds a bound falls by
the largest move of the group's entries; a group is scanned only if its bound is not over the distance to the nearest entry
known so far. Distances that decide are integers, so ties are exact (the lower index wins) and the result is that of a full scan.

A round is one pass without a shuffle: the written table of a round holds the vectors with codes and bounds, and each task's
sums by entry as its last rows; only these sums are shuffled. The driver holds codebooks alone.

Defined cases: a vector that is null or holds null or non-finite components is dropped; one whose length is not that of the first
usable vector, or not a multiple of the number of parts, and one with a component of 2**14 or more in size is kept with null
code and error and teaches nothing; rows with null ids come last in the order of ids, repeated ids are ordered by their
vectors and each row has its own code; fewer rows than entries give a smaller codebook; an empty table gives an empty result;
null labels are one label, one without a coded row has a null sum; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import attach, drop_staged, mapped, staged, table

#: Integers of components are smaller than this, so that squared distances of parts up to 8192 long fit in 64 bits.
LIMIT = 1 << 24
#: Entries to a group, as the method's authors advise.
GROUP = 10
#: Rows that are taken together, so that a block of distances stays small.
ROWS = 2048
_FAR = np.iinfo(np.int64).max
#: What rounding can add to a distance computed from an exact square.
_SLACK = 1 + 1e-12


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, by products of doubles where these are exact, else of integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    out = (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]
    return out.astype(np.int64)


def grouped(entries: np.ndarray) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries themselves, about GROUP to a group."""
    n = max(1, len(entries) // GROUP)
    centres = entries[:: max(1, len(entries) // n)][:n].astype(float)
    for _ in range(5):
        of = ((entries[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(of):
            centres[g] = entries[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1].astype(np.int64)


def _down(low: np.ndarray) -> np.ndarray:
    """Half floats that are not over the given bounds."""
    low = np.clip(low, 0, 60000)
    out = low.astype(np.float16)
    return np.where(out > low, np.nextafter(out, np.float16(0)), out)


def assign(x: np.ndarray, entries: np.ndarray, of: np.ndarray, moved: np.ndarray | None, code: np.ndarray | None, low: np.ndarray | None):
    """(code, squared distance, bounds, number of group scans) of the rows of one part.

    code and low are those of the round before, moved the largest move of each group since; None in the first round.
    """
    rows, groups = np.arange(len(x)), int(of.max()) + 1
    if code is None:
        code, d, low = np.full(len(x), len(entries)), np.full(len(x), _FAR), np.zeros((len(x), groups))
        old, old_d = None, None
    else:
        d = ((x - entries[code]) ** 2).sum(1)
        low = np.clip(low.astype(np.float64) - moved[None, :], 0, None)
        old, old_d = code, d
    code, d = code.copy(), d.copy()
    nearest = np.full((len(x), groups), -1)
    second = np.zeros((len(x), groups))
    scans = 0
    for g in range(groups):
        some = rows if old is None else np.flatnonzero(low[:, g] <= np.sqrt(d) * _SLACK)
        if not len(some):
            continue
        scans += len(some)
        members = np.flatnonzero(of == g)
        near = squares(x[some], entries[members])
        k, here = near.argmin(1), np.arange(len(some))
        first = near[here, k]
        near[here, k] = _FAR
        nearest[some, g], low[some, g], second[some, g] = members[k], np.sqrt(first), np.sqrt(near.min(1))
        better = (first < d[some]) | ((first == d[some]) & (members[k] < code[some]))
        code[some[better]], d[some[better]] = members[k][better], first[better]
    # the own entry does not count for the bound of its group; one that was left counts again
    own = of[code]
    scanned = nearest[rows, own] == code
    low[rows[scanned], own[scanned]] = second[rows[scanned], own[scanned]]
    if old is not None:
        left = np.flatnonzero((old != code) & (nearest[rows, of[old]] < 0))
        low[left, of[old[left]]] = np.minimum(low[left, of[old[left]]], np.sqrt(old_d[left]))
    return code, d, _down(low), scans


def _usable(v: str, parts: int) -> Column:
    sound = (F.size(v) > 0) & (F.size(v) % parts == 0)
    return sound & ~F.exists(v, lambda x: F.abs(x) >= LIMIT)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """vec_id, label, v, usable of the rows whose vector is whole and finite."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & ~bad)
    # a component beyond the limit counts as the limit, so that the conversion cannot overflow
    whole = F.transform("x", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x)) * scale))).cast("int"))
    return rows.select("vec_id", "label", whole.alias("v")).withColumn("usable", _usable("v", parts))


def _round(rows: DataFrame, label_type: str, books: list[np.ndarray], groups: list[np.ndarray], moved: list[np.ndarray] | None, name: str) -> DataFrame:
    """One pass: rows with codes, bounds and errors, and each task's sums by part and entry."""
    parts, first = len(books), moved is None
    widths = np.cumsum([0, *(int(g.max()) + 1 for g in groups)])

    def run(batches):
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, parts, -1)
                codes = np.zeros((b.num_rows, parts), np.uint8)
                bounds = np.zeros((b.num_rows, int(widths[-1])), np.float16)
                error = np.zeros(b.num_rows, np.int64)
                if not first:
                    had = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
                    low = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float16).reshape(b.num_rows, -1)
                for p in range(parts):
                    span = slice(widths[p], widths[p + 1])
                    code, d, kept, _ = assign(v[:, p], books[p], groups[p], None if first else moved[p], None if first else had[:, p], None if first else low[:, span])
                    codes[:, p], bounds[:, span] = code, kept
                    error += d
                    order = np.argsort(code, kind="stable")
                    used, starts = np.unique(code[order], return_index=True)
                    sums[p][used] += np.add.reduceat(v[order, p], starts)
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
                none = pa.nulls(b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2).cast(pa.list_(pa.int32())), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in bounds], pa.binary()), pa.array(error), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))],
                    names,
                )
        found = [(p, e) for p in range(parts) for e in np.flatnonzero(counts[p])]
        if found:
            none = pa.nulls(len(found))
            own = [pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()), pa.array([counts[p][e] for p, e in found], pa.int64()), pa.array([sums[p][e] for p, e in found], pa.list_(pa.int64()))]
            types = (pa.int64(), arrow_label, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(none.cast(t) for t in types), *own], names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_label = to_arrow_type(rows.schema["label"].dataType)
    names = ["vec_id", "label", "v", "codes", "low", "error", "part", "entry", "n", "sums"]
    return staged(mapped(rows, run, f"vec_id long, label {label_type}, v array<int>, codes binary, low binary, error long, part int, entry int, n long, sums array<bigint>"), name)


def _moved_books(done: DataFrame, books: list[np.ndarray], groups: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The next codebooks, and the largest move of each group's entries."""
    size = books[0].shape[1]
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    nxt = [b.copy() for b in books]
    for r in done.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        nxt[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    moved = []
    for old, new, of in zip(books, nxt, groups, strict=True):
        step = np.sqrt(((new - old) ** 2).sum(1)) * _SLACK
        moved.append(np.array([step[of == g].max() for g in range(int(of.max()) + 1)]))
    return nxt, moved


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code array<int>, error) of every whole vector, and the final codebooks; at most 256 entries a part."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    rows = integers(vectors, id_col, vector_col, label_col, scale, parts)
    label_type = rows.schema["label"].dataType.simpleString()
    usable = rows.where("usable")
    order = (F.col("vec_id").asc_nulls_last(), F.col("v"))
    first = usable.select("vec_id", "v").orderBy(*order).limit(entries).collect()
    length = len(first[0]["v"]) if first else 0
    if any(len(r["v"]) != length for r in first):
        first = usable.where(F.size("v") == length).select("vec_id", "v").orderBy(*order).limit(entries).collect()
    fits = F.col("usable") & (F.size("v") == length)
    rest = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not first:
        return rest, []
    seeds = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = [seeds[:, p] for p in range(parts)]
    groups = [grouped(b) for b in books]
    done = _round(rows.where(fits).select("vec_id", "label", "v"), label_type, books, groups, None, "codes")
    for _ in range(rounds):
        books, moved = _moved_books(done, books, groups)
        nxt = _round(done.where("part is null").select("vec_id", "label", "v", "codes", "low"), label_type, books, groups, moved, "codes")
        drop_staged(done)
        done = nxt
    code = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("int"))
    return done.where("part is null").select("vec_id", "label", code.alias("code"), "error").unionByName(rest), books


def label_sums(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors summed over equal labels, nulls together. A label may hold any share of the rows."""
    keys = {"__key": F.coalesce(F.col("label").cast("string"), F.lit("")), "__null": F.col("label").isNull()}
    rows = coded.withColumns(keys)
    sums = rows.groupBy("__key", "__null").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    return attach(rows, sums, ["__key", "__null"], "__n", rows.count()).drop("__key", "__null")


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: 4 parts, 256 entries, 4 rounds."""
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return label_sums(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL with all distances of each round; sums and quotients in whole numbers."""
    near = lambda k: f"""near{k} AS (SELECT x.vec_id, x.p, arg_min(b.e, x.xx - 2 * list_inner_product(x.x, b.x) + b.xx + b.e / 1000.0) AS e, CAST(min(x.xx - 2 * list_inner_product(x.x, b.x) + b.xx) AS bigint) AS d
  FROM part x JOIN book{k} b ON x.p = b.p GROUP BY x.vec_id, x.p)"""  # noqa: E731
    book = lambda k: f"""book{k} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS xx FROM (SELECT b.p, b.e, coalesce(any_value(n.x), any_value(b.x)) AS x FROM book{k - 1} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS double) ORDER BY i) AS x FROM (
      SELECT n.p, n.e, i, sum(CAST(c AS bigint)) AS s, count(*) AS n FROM near{k - 1} n JOIN (SELECT vec_id, p, unnest(x) AS c, unnest(range(len(x))) AS i FROM part) q ON q.vec_id = n.vec_id AND q.p = n.p GROUP BY n.p, n.e, i) GROUP BY p, e
    ) n ON n.p = b.p AND n.e = b.e GROUP BY b.p, b.e))"""  # noqa: E731
    steps = ",\n".join(f"{near(k)},\n{book(k + 1)}" for k in range(4))
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS double) * 1024)) AS v, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, r, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept CROSS JOIN range(4) g(p))),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x, xx FROM part WHERE r <= 256),
{steps},
{near(4)},
sha AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(list_transform(x, lambda c: CAST(CAST(c AS bigint) AS varchar)), ',') AS t FROM book4)),
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS int)), '' ORDER BY p) AS code, CAST(sum(d) AS bigint) AS error FROM near4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id) CROSS JOIN sha"""


OP11_SQL = _sql()
