import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tagsmith.llm import packing as P
from tagsmith.llm import warc as W
from tagsmith.llm.common import shared_root
from tagsmith.llm.tokens import WordBpe

TEXTS = ["it's İstanbul ΑΣ ²³½ don't _foo_ a_b", "<|endoftext|> x", "été été", "'ss 's''s", "漢字 テスト", "a\x1cb\x85c\xa0d", "ﬁne ŉ Ǆ ß ẞ", "“quotes” — dash…", "naïve 10.000,5 'LL 'Re", "", "\n\t "]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = P.default_vocabulary()
    own, theirs = WordBpe(path), Tokenizer.from_file(path)
    for t in TEXTS * 2:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_pieces_tile_the_stream(spark, hard_docs):
    own = WordBpe(P.default_vocabulary())
    pieces = [r.asDict() for r in P.pack(hard_docs, length=64, with_ids=True).collect()]
    texts = [(r[0], r[1]) for r in hard_docs.select("doc_id", "text").collect()]
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at = 0
    for p in stream:
        assert p["sequence_id"] * 64 + p["offset"] == at and p["length"] == len(p["ids"]) > 0
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        at += p["length"]
    docs, now = [], []
    for p in stream:
        now += p["ids"]
        if p["start"] + p["length"] == p["doc_tokens"]:
            docs.append((p["doc_id"], tuple(now)))
            now = []
    want = [(i, (*np.frombuffer(own.encode(t or ""), "<u4").tolist(), 2)) for i, t in texts]
    assert sorted(docs, key=str) == sorted(want, key=str)
    windows = P.sequences(P.pack(hard_docs, length=64, with_ids=True)).collect()
    assert sorted(len(w["ids"]) for w in windows)[1:] == [64] * (len(windows) - 1)


def test_packing_of_nothing(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "long " * 400_000
    rows = [(1, "http://a/", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "http://a/\r\nX: y", "short"), (4, "http://b/", "short"), (5, "http://c/", None), (6, "http://d/", big), (7, "http://e/", "ü\r\n\r\n" * 50), (2, None, "<p>" + "x" * 200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    root = f"{shared_root(spark)}/warc-test"
    index = W.write_bundles(W.plan_records(pages), root)
    got = [r.asDict() for r in W.read_records(index, root, with_payload=True).collect()]
    assert len(got) == len(rows)
    first = defaultdict(lambda: 10**9)
    for i, _, h in rows:
        first[h] = min(first[h], i)
    for r in got:
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        data = html.encode()
        revisit = len(data) >= 100 and first[html] != r["page_id"]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (first[html] if revisit else None)
        assert bytes(r["payload"]) == (b"" if revisit else data)


def test_bundle_frames_are_independent_and_sequential():
    import zstandard

    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    sink = Sink()
    w = W.BundleWriter(sink)
    records = [bytes([65 + i]) * (W.FRAME_BYTES // 3) for i in range(7)]
    places = [w.add(r) for r in records]
    w.close()
    assert len(w.frames) == 3
    reader = W.BundleReader(pa.BufferReader(sink.kept))
    for r, (frame, offset) in reversed(list(zip(records, places, strict=True))):
        assert reader.read(frame, offset, len(r)) == r
    whole = zstandard.ZstdDecompressor().stream_reader(sink.kept, read_across_frames=True).read()
    assert whole == b"".join(records)


def test_warc_of_nothing(spark):
    root = f"{shared_root(spark)}/warc-none"
    index = W.write_bundles(W.plan_records(spark.createDataFrame([], "page_id long, url string, html string")), root)
    assert W.read_records(index, root).count() == 0
