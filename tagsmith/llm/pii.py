"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower the score.

The kinds email, ip, card and phone are fixed by their patterns and checks alone; their spans stay whatever their score. The
kinds iban, ssn, dni, tel and birth are proposed by looser patterns and stay only from THRESHOLD on, so most of them need a
checksum or a word nearby. A span of the second group that overlaps one of the first, or a better or earlier one, goes.

Texts are read once, each pattern in time linear in the text, by tasks that hold one batch; there is no shuffle.

Defined cases: null counts as empty; an empty text has no spans; ties of the score go to the earlier start, then to the kind
listed first; every row gets its own answer, repeated rows and null ids too; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.llm.common import mapped, table

#: Code points before and after a span in which words count.
BEFORE, AFTER = 48, 24
#: The least score of a span that the fixed patterns do not give.
THRESHOLD = 0.6

#: Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: The check letters of Spanish identity numbers, by the remainder of 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

Spans = Iterator[tuple[int, int]]


def luhn(digits: str) -> bool:
    """The sum of digits, every second one from the right doubled and its digits added, is a multiple of ten."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Country and check digits go last, letters become numbers from 10 on, and the remainder of 97 is one."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Spans:
    """Found from their @, as a search for the part before it would try every start of a long run of letters."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")


def _ips(text: str) -> Spans:
    """Runs of digits with single dots between them, four at a time."""
    for m in _CHAIN.finditer(text):
        runs, at = m.group().split("."), m.start()
        for i in range(0, len(runs) - 3, 4):
            four = runs[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n) <= 3 and int(n or "0") <= 255 for n in (r.lstrip("0") for r in four)):
                yield at, end
            at = end + 1


_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _cards(text: str) -> Spans:
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Spans:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            yield m.span()


_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")


def _ibans(text: str) -> Spans:
    """An account number of its country's length that passes mod 97; what follows in capitals is not part of it."""
    at = 0
    while m := _IBAN.search(text, at):
        at, want, have = m.start() + 2, IBAN_LENGTHS.get(m[1], 0), 0
        for end in range(m.start(), m.end()):
            have += text[end] != " "
            if have == want:
                whole = end + 1 == len(text) or not text[end + 1].isalnum()
                if whole and mod97(text[m.start() : end + 1].replace(" ", "")):
                    at = end + 1
                    yield m.start(), end + 1
                break


_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DNI = re.compile(r"(?<![A-Za-z0-9])([0-9]{8})-?([A-Z])(?![A-Za-z0-9])")
_TEL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])")
_BIRTH = re.compile(r"(?<![0-9./-])(?:([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})|([0-9]{4})-([0-9]{2})-([0-9]{2}))(?![0-9./-]*[0-9])")


def _ssns(text: str) -> Spans:
    return (m.span() for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")


def _dnis(text: str) -> Spans:
    return (m.span() for m in _DNI.finditer(text) if DNI_LETTERS[int(m[1]) % 23] == m[2])


def _tels(text: str) -> Spans:
    return (m.span() for m in _TEL.finditer(text))


def _births(text: str) -> Spans:
    for m in _BIRTH.finditer(text):
        a, b, year = (int(m[1]), int(m[3]), int(m[4])) if m[1] else (int(m[7]), int(m[6]), int(m[5]))
        if 1900 <= year <= 2030 and ((1 <= a <= 31 and 1 <= b <= 12) or (1 <= b <= 31 and 1 <= a <= 12)):
            yield m.span()


@dataclass(frozen=True)
class Kind:
    """What proposes and confirms the spans, their score without words nearby, and the words that raise or lower it."""

    name: str
    spans: Callable[[str], Spans]
    base: bool
    score: float
    raising: str = ""
    lowering: str = ""


KINDS = (
    Kind("email", _emails, True, 0.9, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", _ips, True, 0.6, "ip|address|host|server|login|client|adresse", "version|release|section|chapter|v"),
    Kind("card", _cards, True, 0.8, "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", "order|isbn|invoice|serial|tracking"),
    Kind("phone", _phones, True, 0.8, "phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone"),
    Kind("iban", _ibans, False, 0.9, "iban|account|bank|konto|cuenta|compte"),
    Kind("ssn", _ssns, False, 0.4, "ssn|social|security|taxpayer", "order|part|model"),
    Kind("dni", _dnis, False, 0.4, "dni|nif|identidad|documento"),
    Kind("tel", _tels, False, 0.3, "phone|tel|call|fax|mobile|cell|contact", "order|isbn|invoice|serial"),
    Kind("birth", _births, False, 0.3, "born|birth|birthday|dob|geboren|geburtsdatum|nacido|nacida|nacimiento|né|née|naissance"),
)
#: What a word nearby adds to a score, or takes off.
WEIGHT = 0.35
_NEAR = {k.name: tuple(re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.IGNORECASE) if words else None for words in (k.raising, k.lowering)) for k in KINDS}


def scored(kind: Kind, text: str, start: int, end: int) -> float:
    raising, lowering = _NEAR[kind.name]
    near = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    score = kind.score + WEIGHT * bool(raising and raising.search(near)) - WEIGHT * bool(lowering and lowering.search(near))
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of a text's spans, by start, then by the order of KINDS."""
    kept, loose = [], []
    for i, k in enumerate(KINDS):
        for start, end in k.spans(text):
            s = scored(k, text, start, end)
            if k.base:
                kept.append((start, i, end, s))
            elif s >= THRESHOLD:
                loose.append((-s, start, i, end))
    if loose:
        kept = _with_loose(kept, loose)
    return [(KINDS[i].name, start, end, s, KINDS[i].base) for start, i, end, s in sorted(kept)]


def _with_loose(kept: list, loose: list) -> list:
    """The base spans and, best first, the others that overlap nothing taken before. Spans of a kind never overlap."""
    taken: dict[int, list[tuple[int, int]]] = {}
    step = 64
    for start, _, end, _ in kept:
        for b in range(start // step, end // step + 1):
            taken.setdefault(b, []).append((start, end))
    out = list(kept)
    for s, start, i, end in sorted(loose):
        blocks = range(start // step, end // step + 1)
        if any(a < end and start < z for b in blocks for a, z in taken.get(b, ())):
            continue
        out.append((start, i, end, -s))
        for b in blocks:
            taken.setdefault(b, []).append((start, end))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, spans of every row, in code points, ends exclusive."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                found = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in find(t or "")] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    rows = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k.name) for k in KINDS if k.base], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
