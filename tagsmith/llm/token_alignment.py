"""Alignment of two tokenizers' ids over the same bytes, by a transducer over dangling suffixes.

At any byte one side leads: its last token reaches beyond what the other has said. A state is the side and those unmatched
bytes; the next token of the other side shortens them, ends them (the group closes) or overtakes, and then leads itself. Steps
depend on the state and the token alone, so they are kept, and texts repeat few of them. Each step links the leading
token with the new one, which gives all pairs of occurrences that share bytes.

The number of documents in which a pair of ids is linked is counted over the whole table. Documents are taken in runs of a
bounded number of bytes; a run is one row with its different pairs once, and each document's pairs as places in that list. So a
pair enters the count, and its count returns, once a run and not once a document. A frequent pair has at most one row a
run there, so no key of these joins holds more than one row in as many as a run has pairs.

Defined cases: null and empty texts, and those whose joined token bytes on one side are not the text's, have no tokens: zeros and
''; each row is aligned and counted by itself, repeated rows and null ids too; a very long text is a run of its own; ties for a
token's most frequent partner all count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsmith.deploy import ship
from tagsmith.llm.common import mapped, staged, table
from tagsmith.llm.tokens import byte_letters

#: Bytes of text in a run.
RUN_BYTES = 2_000_000
#: Steps that are kept; when there are more, all are dropped before the next text.
STEPS = 1_000_000
#: A pair of ids is one long: the first id, then 16 bits of the second.
B_BITS = 16

#: Characters whose classes the two libraries for the first side agree on (a test tries each); other texts take the slower one.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


class Side:
    """A tokenizer: encode(text) -> ids, and the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces


def byte_level(path: str, ranks: str | None = None, pattern: str | None = None) -> Side:
    """A byte-level BPE from a tokenizers file; the text gets a space before it. ranks and pattern: the same vocabulary for tiktoken, which is faster."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    spelt = (t.id_to_token(i) or "" for i in range(t.get_vocab_size()))
    pieces = [bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode() for s in spelt]
    slow = lambda text: t.encode(" " + text, add_special_tokens=False).ids
    if ranks is None:
        return Side(slow, pieces)
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
    return Side(lambda text: slow(text) if _OTHER.search(text) else fast(" " + text), pieces)


def piece_level(path: str) -> Side:
    """A sentencepiece model with byte fallback, which puts the space before the text itself."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    if m.get_piece_size() > 1 << B_BITS:
        raise ValueError("the second side's ids must fit in 16 bits")
    named = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    pieces = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
    return Side(lambda text: m.encode(text), pieces)


class Transducer:
    """Groups and links of two id sequences over the same bytes; state 0 is the empty residual."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[bool, bytes], int] = {}
        self.leads, self.residuals = [False], [b""]
        self.first: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.said: dict[int, str] = {}

    def _state(self, a_leads: bool, residual: bytes) -> int:
        if not residual:
            return 0
        key = (a_leads, residual)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = len(self.leads)
            self.leads.append(a_leads)
            self.residuals.append(residual)
        return s

    def _step(self, a_leads: bool, residual: bytes, token: bytes) -> int:
        """The state after the other side's token; -1 where the bytes differ."""
        if residual.startswith(token):
            return self._state(a_leads, residual[len(token) :])
        if token.startswith(residual):
            return self._state(not a_leads, token[len(residual) :])
        return -1

    def align(self, a: list[int], b: list[int]) -> tuple[array, list[str]] | None:
        """(links as pairs of ids in one long, groups as text), or None where the bytes differ."""
        if len(self.first) + len(self.next) > STEPS:
            self._forget()
        links, groups = array("q"), []
        link, first, following, said, leads = links.append, self.first, self.next, self.said, self.leads
        i = j = 0
        na, nb = len(a), len(b)
        while i < na and j < nb:
            i0, j0 = i, j
            x, y = a[i], b[j]
            pair = x << B_BITS | y
            i += 1
            j += 1
            link(pair)
            s = first.get(pair)
            if s is None:
                s = first[pair] = self._step(True, self.a[x], self.b[y])
            if not s:
                t = said.get(pair)
                if t is None:
                    t = said[pair] = f"{x}|{y}"
                groups.append(t)
                continue
            while s > 0:
                if leads[s]:
                    if j == nb:
                        return None
                    y = b[j]
                    j += 1
                    key = s << 20 | y
                else:
                    if i == na:
                        return None
                    x = a[i]
                    i += 1
                    key = s << 20 | x
                link(x << B_BITS | y)
                nxt = following.get(key)
                if nxt is None:
                    nxt = following[key] = self._step(leads[s], self.residuals[s], self.b[y] if leads[s] else self.a[x])
                s = nxt
            if s < 0:
                return None
            groups.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
        return (links, groups) if i == na and j == nb else None


@cache
def _sides(a: tuple, b: tuple) -> tuple[Side, Side, Transducer]:
    """The loaded tokenizers of this worker."""
    left, right = byte_level(*a), piece_level(*b)
    return left, right, Transducer(left.pieces, right.pieces)


class _Run:
    """Documents of one run, until they are written as one row."""

    def __init__(self):
        self.bytes, self.ids, self.docs, self.pairs, self.times = 0, [], [], [], []

    def add(self, doc, text: str, sides, with_groups: bool) -> None:
        a_side, b_side, transducer = sides
        self.ids.append(doc)
        raw = b" " + text.encode()
        self.bytes += len(raw)
        a, b, found = [], [], None
        if text:
            a, b = a_side.encode(text), b_side.encode(text)
            if b"".join(map(a_side.pieces.__getitem__, a)) == raw and b"".join(map(b_side.pieces.__getitem__, b)) == raw:
                found = transducer.align(a, b)
        if found is None:
            self.docs.append((0, 0, 0, 0, "", "" if with_groups else None))
            self.pairs.append(np.zeros(0, np.int64))
            self.times.append(np.zeros(0, np.uint32))
            return
        links, groups = found
        pairs, times = np.unique(np.frombuffer(links, np.int64), return_counts=True)
        said = ";".join(groups)
        self.docs.append((len(a), len(b), len(groups), len(links), hashlib.sha256(said.encode()).hexdigest(), said if with_groups else None))
        self.pairs.append(pairs)
        self.times.append(times.astype(np.uint32))

    def row(self, run: int, id_type: pa.DataType) -> pa.RecordBatch:
        every = np.concatenate(self.pairs)
        pairs, place, docs = np.unique(every, return_inverse=True, return_counts=True)
        place = place.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
        cols = list(zip(*self.docs, strict=True))
        one = lambda v, t: pa.array([v], pa.list_(t))
        longs = [one(list(c), pa.int64()) for c in cols[:4]]
        return pa.RecordBatch.from_arrays(
            [pa.array([run]), one(self.ids, id_type), *longs, one(list(cols[4]), pa.string()), one(list(cols[5]), pa.string()), one(pairs, pa.int64()), one(docs, pa.int64()), one([len(p) for p in self.pairs], pa.int64()), pa.array([place.tobytes()], pa.binary()), pa.array([np.concatenate(self.times).tobytes()], pa.binary())],
            _RUN,
        )


_RUN = ["run", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "said", "pairs", "docs", "sizes", "places", "times"]


def aligned_runs(docs: DataFrame, id_col: str, text_col: str, a: tuple, b: tuple, with_groups: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row a run of documents: their ids and counts, the different pairs of the run, in how many of its documents each is, and each document's."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        sides, at, number = _sides(a, b), _Run(), 0
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                some = batch.slice(low, 100)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    at.add(doc, text or "", sides, with_groups)
                    if at.bytes >= run_bytes:
                        yield at.row(part + number, some.column(0).type)
                        at, number = _Run(), number + 1
                kind = some.column(0).type
        if at.ids:
            yield at.row(part + number, kind)

    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"run long, ids array<{id_type}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, said array<string>, pairs array<bigint>, docs array<bigint>, sizes array<bigint>, places binary, times binary"
    return mapped(rows, run, schema)


def link_counts(runs: DataFrame) -> DataFrame:
    """pair, a, b, n (documents in which the pair is linked), best (no pair of this a has more)."""
    counts = runs.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    counts = counts.withColumns({"a": F.shiftright("pair", B_BITS), "b": F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))})
    # an id has at most as many partners as the other vocabulary has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _per_document(runs: pa.Table, counts: pa.Table) -> pa.Table:
    r = {c: runs.column(c)[0].as_py() for c in _OUT}
    order = np.argsort(counts.column("pair").to_numpy())
    n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
    place = np.frombuffer(r["places"], np.uint16 if len(n) <= 1 << 16 else np.uint32)
    times = np.frombuffer(r["times"], np.uint32).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n[place] * times)])
    most = np.concatenate([[0], np.cumsum(best[place] * times)])
    ends = np.cumsum([0, *r["sizes"]])
    per = lambda t: pa.array(t[ends[1:]] - t[ends[:-1]], pa.int64())
    kind = runs.schema.field("ids").type.value_type
    longs = [pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays([pa.array(r["ids"], kind), *longs, per(most), per(total), pa.array(r["digests"], pa.string()), pa.array(r["said"], pa.string())], ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest", "groups"])


_OUT = ("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "said", "sizes", "places", "times")


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: tuple | None = None, b: tuple | None = None, with_groups: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, digest (of the groups' text) and groups (their text, if asked for) of every row.

    a: arguments of byte_level, b: of piece_level. n_best counts the links whose pair is its first id's most frequent one,
    count_sum sums the pairs' document counts over the links.
    """
    import public_tokenizers as known

    a = a or (known.path("byte_bpe_50k.json"), known.path("byte_bpe_50k.tiktoken"), known.PATTERN)
    b = b or (known.path("piece_bpe_32k.model"),)
    ship(docs.sparkSession)
    runs = staged(aligned_runs(docs, id_col, text_col, a, b, with_groups, run_bytes), "token-runs")
    back = runs.select(F.col("run").alias("of"), F.explode("pairs").alias("pair")).join(link_counts(runs).select("pair", "n", "best"), "pair")
    # a run without pairs has no row in back, and comes to the function with an empty table
    id_type = runs.schema["ids"].dataType.elementType.simpleString()
    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string, groups string"
    out = runs.select("run", *_OUT).groupBy("run").cogroup(back.groupBy("of")).applyInArrow(_per_document, schema)
    return out.withColumnRenamed("id", id_col)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE against pieces."""
    rows = align_tokenizers(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
