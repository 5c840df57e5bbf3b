"""Text normalisation for labels as Column expressions; all stay inside code generation.

Python's white space is spelt out, because Java's and RE2's short classes are narrower.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space and line ends, as Java character classes. Java tests single Latin characters by one look into a table
#: and all else in turn, so the rest stands behind one test of its range.
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
TOKEN = "[A-Z0-9]+(?:[-./%][A-Z0-9]+)*"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def squeeze(c: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def compare_form(c: Column) -> Column:
    """Upper case, typographic dashes and quotes plain, | read as I, white space squeezed."""
    return squeeze(F.translate(F.upper(_text(c)), "—–−“”‘’|", "---\"\"''I"))


def key_form(c: Column) -> Column:
    """compare_form without anything but A-Z and 0-9."""
    return F.regexp_replace(compare_form(c), "[^A-Z0-9]", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(compare_form(c), F.lit(TOKEN), F.lit(0))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(NUMBER), F.lit(0))


def numeric_difference(approval: Column, sample: Column) -> Column:
    """The approval's numbers are not the sample's, in order; never where the approval has none."""
    a, s = numbers(approval), numbers(sample)
    return F.when(F.size(a) == 0, False).when(F.size(s) == 0, True).otherwise(a != s)


def tolerant_equal(approval: Column, sample: Column) -> Column:
    a, s = key_form(approval), key_form(sample)
    return (a != "") & (a == s)


def label_form(c: Column) -> Column:
    """A field label: upper case, separators as spaces, trailing . : ; dropped."""
    c = F.translate(strip(F.upper(_text(c))), "—–_|", "--  ")
    return squeeze(F.regexp_replace(F.regexp_replace(c, "[.:;]+$", ""), "-+", " "))


def line_form(c: Column) -> Column:
    """A line of label text: plain dashes, single spaces, case kept."""
    c = F.regexp_replace(F.translate(_text(c), "—–−", "---"), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{2,}", "\n"))


def clean_value(c: Column) -> Column:
    """A field value without separators around it. One search finds the values that are so already."""
    text = F.regexp_replace(line_form(c), rf"^[{SPACE}:=;|,\-]+", "")
    return F.when(~c.rlike(r"[^ -~]|  |^[ :=;|,\-]|[ :=;|]$"), c).otherwise(squeeze(F.regexp_replace(text, f"[{SPACE}:=;|]+$", "")))


def once(value: Column, use) -> Column:
    """use(value) with the value made once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def value_after(line: Column, at: Column) -> Column:
    """clean_value of what follows the first at characters of a line; the separators that begin it go first, as the rest mostly is clean then."""
    return once(F.ltrim(F.substring(line, at + 1, F.length(line)), F.lit(" :=;|,-")), clean_value)


def is_noise(c: Column) -> Column:
    """At most one letter or digit in upper case; two plain ones settle it without the case mapping."""
    return ~_text(c).rlike("[A-Za-z0-9][^A-Za-z0-9]*[A-Za-z0-9]") & (F.length(F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]+", "")) <= 1)


def ocr_word(c: Column) -> Column:
    return squeeze(_text(c))


def ocr_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.translate(_text(c), "\xa0—–−", " ---"), "[ \t]+", " "))


def duplicate_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(_text(c)), "[^A-Z0-9]+", "")


def is_useful_line(c: Column) -> Column:
    return F.regexp_count(_text(c), F.lit("[A-Za-z0-9]")) >= 2


def barcode_form(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.upper(_text(c))), f"[{SPACE}]+", ""), r"[^A-Z0-9\-._/]+", "")


def highlight_form(c: Column) -> Column:
    return squeeze(F.translate(F.upper(_text(c)), "—–−_|", "----I"))


def highlight_key(c: Column) -> Column:
    return F.regexp_replace(highlight_form(c), "[^A-Z0-9]", "")


def highlight_words(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit("[A-Za-z0-9]+(?:[-./%][A-Za-z0-9]+)*"), F.lit(0))


def or_default(c: Column, default: str = "-") -> Column:
    return F.coalesce(F.nullif(strip(_text(c)), F.lit("")), F.lit(default))


def markup(c: Column, default: str = "-") -> Column:
    """Text for a report cell: escaped, line ends as breaks."""
    out = or_default(c, default)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


#: The colours of report cells by status.
STATUS_COLORS = {"PASS": "#198754", "MATCH": "#198754", "FAIL": "#DC3545", "MISMATCH": "#DC3545", "MISSING": "#FD7E14", "EXTRA": "#0D6EFD"}


def status_color(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STATUS_COLORS.items() for x in kv])
    return F.coalesce(table[F.upper(strip(_text(c)))], F.lit("#6C757D"))


def is_tidy(text: Column) -> Column:
    """Printable ASCII in lines, without white space that line_form or squeeze would change."""
    return ~text.rlike("[^\n -~]") & ~text.contains("  ") & ~text.contains(" \n") & ~text.contains("\n ") & ~text.startswith(" ") & ~text.endswith(" ")


#: What a form does to a tidy text as a whole.
_TIDY = {compare_form: lambda text: F.replace(F.upper(text), F.lit("|"), F.lit("I")), line_form: lambda text: text}


def lines(c: Column, form=compare_form) -> Column:
    """Non-blank lines, each in the given form; a tidy text takes it as a whole."""
    text = _text(c)
    parts = F.transform(F.split(text, LINE_END), form)
    if form in _TIDY:
        parts = F.when(is_tidy(text), F.split(_TIDY[form](text), "\n")).otherwise(parts)
    return F.filter(parts, lambda x: x != "")
