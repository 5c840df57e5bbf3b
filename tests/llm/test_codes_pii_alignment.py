import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers as known
import pytest
from pyspark.sql import functions as F

from tagsmith.llm import pii, token_alignment as ta, vector_codes as vc

NAN, INF = float("nan"), float("inf")


# --- vector codes --------------------------------------------------------------------------------------------


def full_scan(rows, parts, entries, rounds):
    """Lloyd's algorithm with every distance: {row: (code, error)} and the codebooks, in Python's whole numbers."""
    ints = [(i, k, [int(np.floor(x * 1024)) for x in v]) for i, (k, v) in enumerate(rows)]
    size = len(ints[0][2]) // parts
    cut = {i: [tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for i, _, v in ints}
    seeds = [i for i, k, v in sorted(ints, key=lambda r: (r[1], r[2]))][:entries]
    books = [[cut[i][p] for i in seeds] for p in range(parts)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda: {i: [min((dist(x, c), e) for e, c in enumerate(books[p])) for p, x in enumerate(xs)] for i, xs in cut.items()}
    for _ in range(rounds):
        got = near()
        for p, e in itertools.product(range(parts), range(len(seeds))):
            mine = [cut[i][p] for i in cut if got[i][p][1] == e]
            if mine:
                books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    got = near()
    return {i: ([e for _, e in g], sum(d for d, _ in g)) for i, g in got.items()}, books


@pytest.mark.parametrize(("seed", "entries", "spread"), [(1, 30, 400), (2, 64, 6), (3, 7, 3)])
def test_codes_equal_a_full_scan(spark, seed, entries, spread):
    rnd = random.Random(seed)
    # few different values give many ties and equal entries
    rows = [(rnd.randrange(400), [rnd.randrange(-spread, spread) / 1024 for _ in range(12)]) for _ in range(300)]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "vec_id long, embedding array<double>, label long").repartition(5)
    coded, books = vc.vector_codes(df, parts=3, entries=entries)
    want, want_books = full_scan(rows, 3, entries, 4)
    assert [[tuple(map(int, e)) for e in b] for b in books] == want_books
    assert {r["label"]: (list(r["code"]), r["error"]) for r in coded.collect()} == want


def test_bounds_spare_groups():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-5000, 5000, (60, 8))
    x = (centres[rnd.integers(0, 60, 3000)] + rnd.integers(-50, 50, (3000, 8))).astype(np.int64)
    entries = x[:60]
    of = vc.grouped(entries)
    code, d, low, _ = vc.assign(x, entries, of, None, None, None)
    moved = np.zeros(int(of.max()) + 1)
    again, d2, _, scans = vc.assign(x, entries, of, moved, code, low)
    assert (again == code).all() and (d == d2).all() and scans < 0.25 * len(x) * len(moved)


def test_large_components_are_exact():
    x, e = np.array([[vc.LIMIT - 1, 1 - vc.LIMIT] * 8]), np.array([[1 - vc.LIMIT, vc.LIMIT - 2] * 8])
    assert vc.squares(x, e)[0, 0] == 8 * ((2 * vc.LIMIT - 2) ** 2 + (2 * vc.LIMIT - 3) ** 2)


def test_hard_vectors(spark):
    good = [float(i) / 64 for i in range(8)]
    rows = [(1, good, 1), (1, good, 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0], 1), (4, [NAN] * 8, 1), (5, [1.0, INF] * 4, 1), (6, [1.0] * 7, None), (7, [1.0] * 4, None), (8, [1e30] * 8, 2), (None, good[::-1], None), (9, [], 3)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, error double")
    coded, books = vc.vector_codes(df)
    got = {(r["vec_id"], r["label"]): r for r in vc.label_sums(coded).collect()}
    assert vc.label_sums(coded).count() == 7 and len(books[0]) == 3
    # a part that is equal in two entries takes the lower one
    assert got[1, 1]["error"] == 0 and list(got[1, 1]["code"]) == [0, 0, 0, 0] and got[1, 1]["label_error"] == 0
    assert got[None, None]["error"] == 0 and got[None, None]["label_error"] == 0
    assert got[6, None]["code"] is None and got[8, 2]["error"] is None and got[8, 2]["label_error"] is None
    empty, books = vc.vector_codes(df.limit(0))
    assert empty.count() == 0 and books == []


# --- personal data -------------------------------------------------------------------------------------------

#: The four fixed patterns, read plainly.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits[::-1])) % 10):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(4)
    bits = ["@", "a", "b.c", ".", "..", "-", "1", "12", "255", "256", "0", "007", "+", "+4", " ", " (", ")", "4111111111111111", "4111 1111 1111 1111", "x@y.z", "é", "10.0.0.1", "\n", "%"]
    for _ in range(6000):
        text = "".join(rnd.choices(bits, k=rnd.randrange(1, 24)))
        assert [f"{k}:{s}:{e}" for k, s, e, _, base in pii.find(text) if base] == plain_base(text), text


def test_long_runs_take_linear_time():
    for unit in ("1", "a", "1.", "@", "a@", "+1", "+", "(", "a@b", "1-", "A1", "DE44"):
        pii.find(unit * 200_000)


def names(text):
    return [(k, text[s:e]) for k, s, e, _, _ in pii.find(text)]


def test_checksums_and_words_nearby():
    assert names("pay to DE89 3704 0044 0532 0130 00 NOW") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert names("pay to DE89 3704 0044 0532 0130 01 NOW") == []
    assert names("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert names("my SSN is 219-09-9999.") == [("ssn", "219-09-9999")]
    assert names("item 219-09-9999.") == [] and names("SSN 666-09-9999") == []
    assert names("DNI 12345678Z") == [("dni", "12345678Z")] and names("DNI 12345678A") == [] and names("ref 12345678Z") == []
    assert names("call (212) 555-0147") == [("tel", "(212) 555-0147")] and names("order (212) 555-0147") == []
    assert names("born 12.05.1987 in") == [("birth", "12.05.1987")] and names("on 12.05.1987 in") == []
    # the base span wins over a looser one, and keeps its place with a low score
    assert names("call +1 212 555 0147") == [("phone", "+1 212 555 0147")]
    (low,) = pii.find("version 1.2.3.4")
    assert low[0] == "ip" and low[3] < pii.THRESHOLD and low[4]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("FR1420041010050500013M02606")


def test_personal_data_of_hard_rows(spark, hard_docs, tmp_path):
    extra = spark.createDataFrame([(None, "x@y.z 10.0.0.1"), (99, "+12 345 678 901 é4111111111111111")], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in hard_docs.dtypes[2:]])
    docs = hard_docs.unionByName(extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] or -1, r["spans"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.op12_personal_data(spark, str(tmp_path)).collect())
    want = []
    for r in docs.collect():
        base = plain_base(r["text"] or "")
        n = [sum(s.startswith(k) for s in base) for k in PLAIN]
        want.append((r["doc_id"] or -1, ",".join(base), hashlib.sha256(",".join(base).encode()).hexdigest(), *n))
    assert got == sorted(want)
    assert pii.personal_data(docs.limit(0)).count() == 0


# --- token alignment -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    a = ta.byte_level(known.path("byte_bpe_50k.json"), known.path("byte_bpe_50k.tiktoken"), known.PATTERN)
    return a, ta.piece_level(known.path("piece_bpe_32k.model"))


def brute(sides, text):
    """Tokens, groups and links from byte ranges; None without tokens."""
    if not text:
        return None
    spans = []
    for side in sides:
        ids, at, out = side.encode(text), 0, []
        for i in ids:
            out.append((i, at, at + len(side.pieces[i])))
            at = out[-1][2]
        if b"".join(side.pieces[i] for i in ids) != (" " + text).encode():
            return None
        spans.append(out)
    a, b = spans
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    inside = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if lo <= s and e <= hi)
    groups = [f"{inside(a, lo, hi)}|{inside(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False)]
    links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    return len(a), len(b), groups, links


TEXTS = ["one", "Hello world", " two  spaces ", "\n\ttabs\r\n", "naïve café — “quoted”", "漢字 and 😀 faces 👩‍👩‍👧", "x" * 300, "<|endoftext|> <s> </s> <unk> <0x41>", "12345.678", "\x00\x01 nul", "a▁b", "ﬁ ½ Å Å", "العربية हिन्दी", "﻿bom"]


def test_transducer_equals_byte_ranges(sides):
    transducer = ta.Transducer(sides[0].pieces, sides[1].pieces)
    rnd = random.Random(3)
    bits = ["the ", "ing", "é", "ß", "漢", "😀", "  ", "\n", "un", "Ä", "123", "-", "tion ", "▁"]
    for text in [*TEXTS, *("".join(rnd.choices(bits, k=rnd.randrange(1, 30))) for _ in range(300))]:
        want = brute(sides, text)
        if want is None:
            continue
        links, groups = transducer.align(sides[0].encode(text), sides[1].encode(text))
        assert groups == want[2]
        assert sorted(divmod(x, 1 << ta.B_BITS) for x in links) == sorted(want[3])
    assert brute(sides, "a▁b") is None and transducer.align(sides[0].encode("ab"), sides[1].encode("ac")) is None


def test_both_libraries_split_alike(sides):
    slow = ta.byte_level(known.path("byte_bpe_50k.json"))
    for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        c = chr(c)
        for text in (c, f"a{c}b", f"1{c}{c}2", f" {c} x", f"'{c}s {c}'re", f"{c}\n{c} ", f"x {c}{c}  {c}9"):
            assert slow.encode(text) == sides[0].encode(text), text


@pytest.mark.parametrize("run_bytes", [1, 3000, ta.RUN_BYTES])
def test_alignment_of_a_table(spark, hard_docs, sides, run_bytes, tmp_path):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in hard_docs.dtypes[2:]])
    docs = hard_docs.where("doc_id is null or doc_id <> 11").unionByName(extra)
    rows = [(r["doc_id"], brute(sides, r["text"])) for r in docs.collect()]
    count = {}
    for _, r in rows:
        for pair in set(r[3]) if r else ():
            count[pair] = count.get(pair, 0) + 1
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    want = []
    for i, r in rows:
        if r is None:
            want.append((i or -1, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        said = ";".join(r[2])
        want.append((i or -1, r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[0]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(said.encode()).hexdigest(), said))
    got = ta.align_tokenizers(docs, with_groups=True, run_bytes=run_bytes).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == sorted(want)


def test_alignment_query(spark, hard_docs, sides, tmp_path):
    hard_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = ta.op13_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    n = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert n[1]["n_a"] == n[2]["n_links"] == 0 and n[1]["groups_sha256"] == "" and n[11]["n_links"] == n[11]["n_a"] + n[11]["n_b"] - n[11]["n_groups"]
    assert ta.align_tokenizers(hard_docs.limit(0)).count() == 0
