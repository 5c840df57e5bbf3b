"""Concatenate and cut: documents become one stream of tokens, which is cut into windows of a fixed length.

First pass: every input partition writes its documents' ids with their places inside the partition. The partitions'
totals are prefix-summed into global offsets. Second pass: each document's global place says where windows cut it;
a document that crosses a border becomes one boundary record more per border. No ids move between tasks in either
pass, and only the last window is padded.

Defined cases: null or empty text is its end token alone; a long text crosses many windows; repeated rows and ids are
packed once per row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, staged, table
from tagsmith.llm.tokens import WordBpe

_encoders: dict[str, WordBpe] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """part, start (tokens before it in the partition), doc_id, n_tokens, ids (unsigned 16 or 32 bit) of each document."""

    def run(batches):
        if vocabulary not in _encoders:
            _encoders[vocabulary] = WordBpe(vocabulary)
        enc = _encoders[vocabulary]
        end = np.array([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for low in range(0, b.num_rows, 200):
                some = b.slice(low, 200)
                ids = [enc.encode(t or "") + end for t in some.column(1).to_pylist()]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(start), some.column(0), pa.array(n), pa.array([_narrow(i) for i in ids], pa.binary())], ["part", "start", "doc_id", "n_tokens", "ids"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(docs, run, "part int, start long, doc_id long, n_tokens long, ids binary")


def _narrow(ids: bytes) -> bytes:
    """A leading byte says the width: ids below 65536 are kept in 16 bits."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 65536 else b"\x04" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in windows of length tokens: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the piece's ids as an array, from which ``sequences`` builds the windows.
    """
    tokens = staged(token_table(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))
    # one row for each input partition, which the driver schedules one by one: the sums are as small as its task list
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = tokens.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("place"), "n_tokens", "ids")

    def cut(batches):
        for b in batches:
            for low in range(0, b.num_rows, 500):
                cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
                for doc, place, n, packed in zip(*(c.to_pylist() for c in b.slice(low, 500).columns), strict=True):
                    ids, at = _wide(packed), 0
                    while at < n:
                        off = (place + at) % length
                        take = min(length - off, n - at)
                        piece = ids[at : at + take]
                        for k, v in zip(cols, (doc, at, take, zlib.crc32(piece.tobytes()), n, (place + at) // length, off, piece.astype(np.int32) if with_ids else None), strict=True):
                            cols[k].append(v)
                        at += take
                arrays = [pa.array(v, pa.int64()) for v in list(cols.values())[:7]] + [pa.array(cols["ids"], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, list(cols)[: len(arrays)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return mapped(placed, cut, schema).withColumnRenamed("doc_id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each window, from pack(..., with_ids=True); a window's pieces hold at most its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op8_pack_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
