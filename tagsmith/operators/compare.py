"""Comparison of approval and sample labels: fields, lines, merged result, weighted score and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagsmith.deploy import ship
from tagsmith.functions.align import key_ratios, line_opcodes, word_diffs
from tagsmith.functions.rounding import half_even, half_up
from tagsmith.functions.text import key_form, lines, numeric_difference, strip, tokens, tolerant_equal
from tagsmith.settings import DEFAULT

#: The ratio from which unequal texts match, the field threshold and the pass mark; fixed values: the weights.
TEXT_MATCH, FIELD_MATCH, PASS_MARK = DEFAULT.text_match, DEFAULT.field_match, DEFAULT.overall_pass
WEIGHTS = {"text": 0.85, "logo": 0.10, "barcode": 0.05}
STATUSES = {"matched": "MATCH", "mismatched": "MISMATCH", "missing": "MISSING", "extra": "EXTRA", "not_checked": "NOT_CHECKED"}


def counts(status: Column) -> list[Column]:
    """Conditional counts, one per status."""
    return [F.count_if(status == s).alias(n) for n, s in STATUSES.items()]


def with_status(rows: DataFrame, name: str = "fields") -> DataFrame:
    """rows whose array name, of structs with stripped approval and sample, has status and score (percent, null where not checked) besides.

    Equal texts are settled at once, texts that are equal in key form without alignment.
    """
    ship(rows.sparkSession)
    forms = F.transform(name, lambda x: F.when((x["approval"] != "") & (x["sample"] != "") & (x["approval"] != x["sample"]), F.struct(key_form(x["approval"]).alias("a"), key_form(x["sample"]).alias("s"), numeric_difference(x["approval"], x["sample"]).alias("numeric"))))
    hard = lambda x: (x["a"] != x["s"]) & (x["a"] != "") & (x["s"] != "")
    rows = rows.withColumn("__forms", forms)
    some = F.exists("__forms", lambda x: F.coalesce(hard(x), F.lit(False)))
    side = lambda c: F.when(some, F.transform("__forms", lambda x: F.when(hard(x), x[c])))
    rows = rows.withColumn("__ratios", key_ratios(side("a"), side("s")))
    ratio = lambda x, i: F.when(x.isNull() | (x["a"] == x["s"]), 1.0).when((x["a"] == "") | (x["s"] == ""), 0.0).otherwise(F.get("__ratios", i))
    rows = rows.withColumn("__ratios", F.transform("__forms", ratio))

    def told(x, i):
        form, r = F.get("__forms", i), F.get("__ratios", i)
        empty = (x["approval"] == "", x["sample"] == "")
        same = form.isNull() | (form["a"] != "") & (form["a"] == form["s"])
        numeric = F.coalesce(form["numeric"], F.lit(False))
        score = half_up(r * 100, 2)
        match = ~numeric & (same | (r >= TEXT_MATCH)) & (score >= FIELD_MATCH * 100)
        status = F.when(empty[0] & empty[1], "NOT_CHECKED").when(empty[1], "MISSING").when(empty[0], "EXTRA").when(match, "MATCH").otherwise("MISMATCH")
        score = F.when(empty[0] & empty[1], None).when(empty[0] | empty[1], 0.0).otherwise(score)
        return F.struct(*[x[c].alias(c) for c in kinds], status.alias("status"), score.alias("score"))

    kinds = rows.schema[name].dataType.elementType.names
    return rows.withColumn(name, F.transform(name, told)).drop("__forms", "__ratios")


def compare_fields(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows (key, field, field_ord, approval, sample) -> the same with status and score (see with_status)."""
    a, s = strip(F.coalesce("approval", F.lit(""))), strip(F.coalesce("sample", F.lit("")))
    rest = [c for c in pairs.columns if c not in ("approval", "sample")]
    rows = with_status(pairs.select(*rest, F.array(F.struct(a.alias("approval"), s.alias("sample"))).alias("__one")), "__one")
    got = F.get("__one", F.lit(0))
    return rows.select(*[got[c].alias(c) if c in ("approval", "sample") else c for c in pairs.columns], got["status"].alias("status"), got["score"].alias("score"))


def join_fields(approval: DataFrame, sample: DataFrame, key: str = "pair_id") -> DataFrame:
    """Full outer join of two field tables (key, field, field_ord, value)."""
    a = approval.select(key, "field", F.col("field_ord").alias("__a"), F.col("value").alias("approval"))
    s = sample.select(key, "field", F.col("field_ord").alias("__s"), F.col("value").alias("sample"))
    return a.join(s, [key, "field"], "full_outer").select(key, "field", F.coalesce("__a", F.col("__s") + 1000).alias("field_ord"), F.coalesce("approval", F.lit("")).alias("approval"), F.coalesce("sample", F.lit("")).alias("sample"))


def field_result(rows: DataFrame, key: str = "pair_id", of: int | None = None) -> DataFrame:
    """key, counts, total, field_score of compared field rows; of: the number of fields, where rows lack those that are not checked."""
    return scored_fields(rows.groupBy(key).agg(*counts(F.col("status"))), of)


def scored_fields(out: DataFrame, of: int | None = None) -> DataFrame:
    """Counts by status with total and field_score."""
    total = F.col("matched") + F.col("mismatched") + F.col("missing") + F.col("extra")
    if of is not None:
        out = out.withColumn("not_checked", F.lit(of) - total)
    return out.withColumn("total", total).withColumn("field_score", F.when(F.col("total") > 0, half_even(F.col("matched") / F.col("total"), 4)).otherwise(0.0))


def _forced(a: Column, s: Column) -> tuple[Column, ...]:
    """For two unequal lists: the lengths of their common first part (column __head) and last part (column __tail), whether
    their alignment leaves no choice, and its opcodes then.

    It leaves none where no line repeats in a list and the parts between the common first and last lines share none: only the
    common ends can be equal then.
    """
    first = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int") - 1
    n, m, head = F.size(a), F.size(s), F.col("__head")
    cut = lambda x, size: F.reverse(F.slice(x, head + 1, size))
    tail = F.col("__tail")
    inner = lambda x, size: F.slice(x, head + 1, size - head - tail)
    alone = (F.size(F.array_distinct(a)) == n) & (F.size(F.array_distinct(s)) == m) & ~F.arrays_overlap(inner(a, n), inner(s, m))
    code = lambda tag, *at: F.struct(tag.alias("tag"), *[x.cast("int").alias(c) for c, x in zip(("i1", "i2", "j1", "j2"), at, strict=True)])
    zero, equal = F.lit(0), F.lit("equal")
    tag = F.when(n == head + tail, "insert").when(m == head + tail, "delete").otherwise("replace")
    ops = F.array(code(equal, zero, head, zero, head), code(tag, head, n - tail, head, m - tail), code(equal, n - tail, n, m - tail, m))
    return first(a, s), first(cut(a, n), cut(s, m)), alone, F.filter(ops, lambda o: (o["i1"] < o["i2"]) | (o["j1"] < o["j2"]))


def with_lines(pairs: DataFrame, approval: str = "atext", sample: str = "stext") -> DataFrame:
    """pairs with the array lines of (line, approval_line, sample_line, approval, sample, status).

    Opcodes come from the alignment of whole line lists; inside a replaced block lines pair by position.
    """
    ship(pairs.sparkSession)
    a, s = F.col("__a"), F.col("__s")
    head, tail, forced, ops = _forced(a, s)
    rows = pairs.withColumns({"__a": lines(F.col(approval)), "__s": lines(F.col(sample))}).withColumn("__head", F.when(a != s, head)).withColumn("__tail", F.when(a != s, tail))
    whole = F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("i1"), F.size(a).alias("i2"), F.lit(0).alias("j1"), F.size(s).alias("j2")))
    rows = rows.withColumn("__ops", F.when(a == s, whole).when(forced, ops))
    hard = F.col("__ops").isNull()
    rows = rows.withColumn("__aligned", line_opcodes(F.when(hard, a), F.when(hard, s))).withColumn("__ops", F.coalesce("__ops", "__aligned"))

    def row(o, k):
        ai, sj = F.when(o["i1"] + k < o["i2"], o["i1"] + k), F.when(o["j1"] + k < o["j2"], o["j1"] + k)
        approval, sample = F.coalesce(F.get(a, ai), F.lit("")), F.coalesce(F.get(s, sj), F.lit(""))
        status = F.when(o["tag"] == "equal", "MATCH").when(sj.isNull(), "MISSING").when(ai.isNull(), "EXTRA").when(tolerant_equal(approval, sample), "MATCH").otherwise("MISMATCH")
        return F.struct((F.coalesce(ai, sj) + 1).alias("line"), ai.alias("approval_line"), sj.alias("sample_line"), approval.alias("approval"), sample.alias("sample"), status.alias("status"))

    each = F.filter("__ops", lambda o: (o["i1"] < o["i2"]) | (o["j1"] < o["j2"]))
    span = lambda o: F.sequence(F.lit(0), F.greatest(o["i2"] - o["i1"], o["j2"] - o["j1"]) - 1)
    found = F.flatten(F.transform(each, lambda o: F.transform(span(o), lambda k: row(o, k))))
    return rows.withColumn("lines", found).drop("__a", "__s", "__head", "__tail", "__ops", "__aligned")


def compare_lines(pairs: DataFrame, key: str = "pair_id", approval: str = "atext", sample: str = "stext") -> DataFrame:
    """Line rows of each pair of texts: key, approval_line, sample_line, approval, sample, status, line (see with_lines)."""
    rows = with_lines(pairs.select(key, approval, sample), approval, sample).select(key, F.inline_outer("lines")).where("line is not null")
    return rows.select(key, "approval_line", "sample_line", "approval", "sample", "status", "line")


def counted(name: str) -> list[Column]:
    """The counts by status of an array of structs with status."""
    having = lambda status: F.filter(name, lambda x: x["status"] == status)
    return [F.size(having(s)).cast("long").alias(n) for n, s in STATUSES.items()]


def visual_diffs(line_rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, type, approval_text, sample_text, approval_line, sample_line: token differences of the lines that differ."""
    ship(line_rows.sparkSession)
    rows = line_rows.where("status <> 'MATCH'")
    join = lambda c: F.array_join(tokens(F.col(c)), " ")
    one = rows.where("status <> 'MISMATCH'").select(key, F.when(F.col("status") == "MISSING", "delete").otherwise("insert").alias("type"), join("approval").alias("approval_text"), join("sample").alias("sample_text"), "approval_line", "sample_line")
    two = rows.where("status = 'MISMATCH'").select(key, F.explode(word_diffs(F.col("approval"), F.col("sample"))).alias("d"), "approval_line", "sample_line")
    return one.unionByName(two.select(key, "d.type", "d.approval_text", "d.sample_text", "approval_line", "sample_line"))


def line_mismatches(line_rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """The lines that differ as rows of a field table, named LINE n, without a score."""
    rows = line_rows.where("status <> 'MATCH'")
    return rows.select(key, F.concat(F.lit("LINE "), F.col("line").cast("string")).alias("field"), "approval", "sample", "status", F.lit(None).cast("double").alias("score"))


def line_result(line_rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, matched, mismatched, missing, extra, total, score."""
    return scored_lines(line_rows.groupBy(key).agg(*counts(F.col("status"))[:4]))


def scored_lines(out: DataFrame) -> DataFrame:
    """Counts by status with total and score."""
    total = F.col("matched") + F.col("mismatched") + F.col("missing") + F.col("extra")
    return out.withColumn("total", total).withColumn("score", F.when(F.col("total") > 0, half_even(F.col("matched") / F.col("total"), 4)))


def summarise(pairs: DataFrame, fields: DataFrame, text: DataFrame, logo: DataFrame | None = None, barcode: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """One row per pair: the merged counts, line counters, score (percent, fraction) and PASS or FAIL.

    fields and text are field_result and line_result; logo and barcode have (key, status).
    """
    f = fields.select(key, *[F.col(c).alias(f"f_{c}") for c in (*STATUSES, "total", "field_score")])
    t = text.select(key, *[F.col(c).alias(f"t_{c}") for c in ("matched", "mismatched", "missing", "extra", "total", "score")])
    return weighed(pairs.select(key).join(f, key, "left").join(t, key, "left"), logo, barcode, key)


def weighed(rows: DataFrame, logo: DataFrame | None = None, barcode: DataFrame | None = None, key: str = "pair_id", keep: tuple = ()) -> DataFrame:
    """The summary of rows with key, field_result's columns named f_ and line_result's named t_; the columns keep stay at its end."""
    for name, df in (("logo", logo), ("barcode", barcode)):
        status = df.select(key, F.upper("status").alias(f"{name}_status")) if df is not None else None
        rows = rows.join(status, key, "left") if status is not None else rows.withColumn(f"{name}_status", F.lit(None).cast("string"))
    by_field = F.coalesce(F.col("f_total"), F.lit(0)) > 0
    pick = lambda c: F.coalesce(F.when(by_field, F.col(f"f_{c}")).otherwise(F.col(f"t_{c}")), F.lit(0))
    out = {c: pick(c) for c in ("matched", "mismatched", "missing", "extra", "total")}
    out["not_checked"] = F.coalesce(F.when(by_field, F.col("f_not_checked")), F.lit(0))
    out["field_score"] = F.coalesce(F.when(by_field, F.col("f_field_score")).otherwise(F.col("t_score")), F.lit(0.0))
    out |= {f"line_{c}": F.coalesce(F.when(by_field, F.col(f"t_{c}")), F.lit(0)) for c in ("mismatched", "missing", "extra")}
    rows = rows.select(key, "logo_status", "barcode_status", *[v.alias(k) for k, v in out.items()], *keep)
    parts = [(F.when(F.col("total") > 0, F.col("field_score")), WEIGHTS["text"])] + [(F.when(F.col(f"{n}_status") == "PASS", 1.0).when(F.col(f"{n}_status") == "FAIL", 0.0), WEIGHTS[n]) for n in ("logo", "barcode")]
    top = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    rows = rows.withColumn("score_fraction", F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), top / weight))).otherwise(0.0))
    wrong = F.lit(False)
    for c in ("mismatched", "missing", "extra", "line_mismatched", "line_missing", "line_extra"):
        wrong = wrong | (F.col(c) > 0)
    for n in ("logo", "barcode"):
        wrong = wrong | F.coalesce(F.col(f"{n}_status") == "FAIL", F.lit(False))
    rows = rows.withColumn("status", F.when(~wrong & (F.col("score_fraction") >= PASS_MARK), "PASS").otherwise("FAIL")).withColumns({"score": half_even(F.col("score_fraction") * 100, 1), "score_fraction": half_even(F.col("score_fraction"), 4)})
    return rows.select(*[c for c in rows.columns if c not in keep], *keep)


