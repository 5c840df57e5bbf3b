"""Secret scans: patterns, and guess costs of values in credential contexts.

Base spans: values assigned to credential names, access key ids, and long runs of hex digits. Beyond them, every
value in a credential context (a credential name, then a separator) is segmented at minimum cost by dynamic
programming: dictionary words (log2 of their rank, with capital or leet surcharges), dates, repeats, keyboard walks
and brute-force spans (log2 of the alphabet a character). A value whose cheapest segmentation still costs at least
MIN_BITS bits of guessing is a secret span of kind guess.

Defined cases: null or empty text has no spans; values of any length are segmented whole, in time linear in their
length (a segment is at most MAX_SEGMENT characters, longer ones being sums of such); ties take the earlier kind;
repeated rows are scanned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, table

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS, MIN_LENGTH, MAX_SEGMENT = 36.0, 6, 24

_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: A wider context than the base's: more names, any value without white space.
_CONTEXT = re.compile(r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth|api[_-]?key|private[_-]?key|access[_-]?key|client[_-]?secret)["']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""", re.I | re.A)

#: Common password words by rank, most common first.
WORDS = "password qwerty dragon monkey letmein football baseball welcome admin login master sunshine princess shadow superman michael jordan hunter killer charlie secret summer winter spring autumn flower hello freedom whatever trustno starwars computer internet cheese banana orange purple silver golden diamond ginger pepper cookie soccer hockey tigger buster batman thomas robert daniel jessica ashley jennifer andrew joshua matthew love lover iloveyou angel baby happy lucky money family friend system server database default example sample test testing guest user root changeme demo temp access security service office company london paris america english school student teacher coffee music guitar dance party january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday token key auth value none null true false your here insert placeholder xxxx"
_RANK = {w: i + 1 for i, w in enumerate(WORDS.split())}
_LONGEST = max(map(len, _RANK))
_LEET = str.maketrans("4310$57@8", "aeiosstab")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._](?:0[1-9]|1[0-2])[-/._](?:19|20)?\d\d")


def _neighbours() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for y, row in enumerate(_ROWS):
        for x, c in enumerate(row):
            near = {row[i] for i in (x - 1, x + 1) if 0 <= i < len(row)}
            for dy, dxs in ((-1, (0, 1)), (1, (-1, 0))):
                if 0 <= y + dy < len(_ROWS):
                    near |= {_ROWS[y + dy][x + dx] for dx in dxs if 0 <= x + dx < len(_ROWS[y + dy])}
            out[c] = near
    return out


_NEAR = _neighbours()


def _char_bits(c: str) -> float:
    return log2(10) if c.isdigit() else log2(26) if c.isascii() and c.isalpha() else log2(33) if c.isascii() else log2(1000)


def guess_bits(value: str) -> float:
    """log2 of the guesses that the cheapest segmentation of value needs."""
    n, low = len(value), value.lower()
    leet = low.translate(_LEET)
    best = [0.0] + [float("inf")] * n
    run_of, walk_of = [1] * n, [1] * n
    for i in range(1, n):
        if value[i] == value[i - 1]:
            run_of[i] = run_of[i - 1] + 1
        if low[i] in _NEAR.get(low[i - 1], ()) or abs(ord(low[i]) - ord(low[i - 1])) == 1:
            walk_of[i] = walk_of[i - 1] + 1
    for i in range(1, n + 1):
        # brute force, a character at a time
        cost = best[i - 1] + _char_bits(value[i - 1])
        for size in range(3, min(i, _LONGEST, MAX_SEGMENT) + 1):  # words
            a = i - size
            rank = _RANK.get(low[a:i]) or _RANK.get(leet[a:i])
            if rank:
                plain = value[a:i] == low[a:i]
                cost = min(cost, best[a] + log2(rank) + 1 + (0 if plain else 1 if value[a:i].istitle() or value[a:i].isupper() else 3) + (2 if low[a:i] not in _RANK else 0))
        for longest, bits in ((run_of[i - 1], 3.0), (walk_of[i - 1], 5.0)):  # repeats, walks, their shorter ends too
            for size in range(3, min(longest, MAX_SEGMENT) + 1):
                cost = min(cost, best[i - size] + _char_bits(value[i - size]) + bits + log2(size))
        for size in range(4, min(i, 10) + 1):  # dates
            if value[i - 1].isdigit() and _DATE.fullmatch(value, i - size, i):
                cost = min(cost, best[i - size] + log2(365 * 120) * (0.5 if size < 6 else 1))
        for size in range(2, min(i // 2, MAX_SEGMENT) + 1):  # a block said again
            if value[i - 2 * size : i - size] == value[i - size : i]:
                cost = min(cost, best[i - size] + 3.0)
        best[i] = cost
    return best[n]


#: A text without any of these, in lower case, has no assignment and no context.
_NAMES = ("pass", "secret", "token", "key", "pwd", "pin", "credential", "auth")


def base_spans(text: str, named: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; named: whether a credential name occurs at all."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12] if named else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, bits) of context values that are costly to guess."""
    out = []
    for m in _CONTEXT.finditer(text):
        g = next(i for i in (1, 2, 3) if m[i] is not None)
        a, b = m.span(g)
        while b > a and text[b - 1] in ".!?)":
            b -= 1
        if b - a >= MIN_LENGTH and (bits := guess_bits(text[a:b])) >= MIN_BITS:
            out.append((a, 3, b, bits))
    return out


def all_spans(text: str) -> list[tuple]:
    low = text.lower()
    named = any(n in low for n in _NAMES)
    return sorted([*base_spans(text, named), *(guess_spans(text) if named else ())], key=lambda s: s[:3])


def spelt(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and spans: array of (kind, start, end, bits), bits null for base spans; code points, end exclusive."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        for b in batches:
            for low in range(0, b.num_rows, 500):
                some = b.slice(low, 500)
                spans = [[{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "bits": s[3] if len(s) > 3 else None} for s in all_spans(t or "")] for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, "id long, spans array<struct<kind:string,start:long,end:long,bits:double>>").withColumnRenamed("id", id_col)


def op4_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts and digest of the base spans, and all spans."""
    spans = scan(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"), count("guess"), F.array_max(F.transform("spans", lambda s: s["bits"])).alias("max_bits"))


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(spelt(spans).encode()).hexdigest()
