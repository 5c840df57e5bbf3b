"""Field extraction from label text: alias starts, line parsing as gaps and islands, two fallback searches.

Pairs and single labels are one row each, worked on by arrays of their lines, without a shuffle. found_fields and field_values work on
a table of lines, shuffled once by the label: approvals with many samples read their labels so, as a test of their plan asks.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagsmith.functions.aliases import FIELDS, alternation, labels_of, own_aliases, owners, prefix_tree
from tagsmith.functions.text import SPACE, clean_value, is_noise, line_form, lines, once, value_after

_BREAK = rf"[{SPACE}]|[:=|;\-]"
_END = rf"(?={_BREAK}|$)"
#: Java's (?iu): case folding beyond ASCII, as the reference semantics ask. No word boundary: see line_starts.
_START = rf"(?iu)^({prefix_tree(list(owners()))})"

_ALIAS = "struct<f:int,n:int>"
_HITS = f"struct<own:array<{_ALIAS}>,inner:array<{_ALIAS}>,loose:array<int>>"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by keys into as many partitions as the session asks for: the work behind is heavy for the bytes, so they are not merged by size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def _hits() -> dict[str, tuple]:
    """For the longest label that begins a line: fields that have it, labels inside it that a break follows, fields with any label inside it.

    Every other label that begins the line begins this label, so one search of a line finds all of them.
    """
    named = {f: labels_of(f) for f in FIELDS}
    known = {f: set(own_aliases(f)) for f in FIELDS}
    out = {}
    for label in owners():
        inside = [(i, len(a)) for i, f in enumerate(FIELDS) for a in named[f] if label.startswith(a)]
        own = [(i, n) for i, n in inside if n == len(label)]
        inner = sorted(((i, n) for i, n in inside if n < len(label) and label[n] in " :=|;-"), key=lambda p: (-p[1], p[0]))
        loose = sorted({i for i, f in enumerate(FIELDS) for a in known[f] if label.startswith(a)})
        out[label] = (own, inner, loose)
    return out


@cache
def _literal() -> Column:
    pairs = lambda ps: "array(" + ", ".join(f"named_struct('f', {f}, 'n', {n})" for f, n in ps) + ")"
    row = lambda own, inner, loose: f"cast(named_struct('own', {pairs(own)}, 'inner', {pairs(inner)}, 'loose', array({', '.join(map(str, loose))})) AS {_HITS})"
    return F.expr("map(" + ", ".join(f"'{label}', {row(*hit)}" for label, hit in _hits().items()) + ")")


def unnested(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """keys and the columns of the structs in the array name, a row each.

    The outer form keeps Spark from making the array a second time to test whether it has rows.
    """
    first = rows.schema[name].dataType.elementType.names[0]
    return rows.select(*keys, F.inline_outer(name)).where(F.col(first).isNotNull())


def explode_lines(labels: DataFrame, key: str | tuple = "label_id", text: str = "text", outer: bool = False) -> DataFrame:
    """key, line_no, line: the non-blank normalised lines; outer keeps labels without any, with nulls."""
    keys = (key,) if isinstance(key, str) else key
    parts = lines(F.col(text), line_form)
    return labels.select(*keys, (F.posexplode_outer if outer else F.posexplode)(parts).alias("line_no", "line"))


def line_starts(rows: DataFrame) -> DataFrame:
    """Adds near: array of (f, n, rest), the fields whose label begins the line before a break, longest label first, with the
    label's length and what follows it; and loose: the fields with an alias that begins the line, a break or not.
    """
    found = F.upper(F.regexp_extract("line", _START, 1))
    rows = rows.withColumn("__found", found).withColumn("__hit", F.when(F.col("__found") != "", _literal()[F.col("__found")]))
    ends = F.substring(F.col("line"), F.length("__found") + 1, F.lit(1)).rlike(rf"^(?:{_BREAK}|$)")
    near = F.when(ends, F.concat("__hit.own", "__hit.inner")).otherwise(F.col("__hit.inner"))
    rest = lambda n: clean_value(F.ltrim(F.substring(F.col("line"), n + 1, F.length("line"))))
    near = F.transform(near, lambda e: F.struct(e["f"].alias("f"), e["n"].alias("n"), rest(e["n"]).alias("rest")))
    return rows.withColumns({"near": near, "loose": F.col("__hit.loose")}).drop("__found", "__hit")


def match_start(line: Column) -> Column:
    """struct(field, remainder) of a normalised line that starts with a label, else null; the longest label wins."""
    found = F.upper(F.regexp_extract(line, _START + _END, 1))
    table = F.create_map(*[F.lit(x) for kv in owners().items() for x in kv])
    rest = F.substring(line, F.length(found) + 1, F.length(line))
    return F.when(found != "", F.struct(table[found].alias("field"), clean_value(F.ltrim(rest)).alias("remainder")))


def _parsed(labels: DataFrame, text: str, name: str) -> DataFrame:
    """labels with columns whose names begin with name, arrays by line unless told otherwise.

    lines; found: the longest label that begins a line, "" if none; hits: what _hits says of it; near: array of (f, n), the fields
    whose label begins the line before a break, longest label first, with the label's length; loose (by field): the fields
    with an alias that begins a line, a break or not, in the order of their lines; islands (by line that opens a field): (f, value)
    of the line parser, where other lines but noise go on a field. Each step is a column that the next uses more than once, so none is made twice.
    """
    c = lambda x: F.col(f"{name}_{x}")
    put = lambda rows, **cols: rows.withColumns({f"{name}_{k}": v for k, v in cols.items()})
    rows = put(labels, lines=lines(F.col(text), line_form))
    rows = put(rows, found=F.transform(c("lines"), lambda x: once(F.regexp_extract(x, _START, 1), lambda v: F.when(v.rlike("[^A-Z ]"), F.upper(v)).otherwise(v))))
    rows = put(rows, hits=F.transform(c("found"), lambda x: F.when(x != "", _literal()[x])))
    after = lambda i: F.substring(F.get(c("lines"), i), F.length(F.get(c("found"), i)) + 1, F.lit(1))
    ends = lambda i: after(i).rlike(rf"^(?:{_BREAK}|$)")
    near = F.transform(c("hits"), lambda h, i: F.when(h.isNotNull(), F.when(ends(i), F.concat(h["own"], h["inner"])).otherwise(h["inner"])))
    loose = F.array_distinct(F.flatten(F.transform(F.filter(c("hits"), lambda h: h.isNotNull()), lambda h: h["loose"])))
    rows = put(rows, near=near, loose=loose)
    opens = F.transform(c("near"), lambda x, i: F.when(F.size(x) > 0, i))
    rows = put(rows, starts=F.filter(opens, lambda i: i.isNotNull()))

    def island(b, k):
        n = F.coalesce(F.get(c("starts"), k + 1), F.size(c("lines"))) - b - 1
        more = F.filter(F.slice(c("lines"), b + 2, n), lambda x: ~is_noise(x))
        whole = lambda rest: F.when(F.size(more) == 0, rest).otherwise(once(F.array_join(F.concat(F.filter(F.array(rest), lambda x: x != ""), more), " "), clean_value))
        said = lambda first: F.struct(first["f"].alias("f"), once(value_after(F.get(c("lines"), b), first["n"]), whole).alias("value"))
        return once(F.get(F.get(c("near"), b), F.lit(0)), said)

    return put(rows, islands=F.transform(c("starts"), island))


def _last(name: str, numbers: Column) -> Column:
    """array of (f, value) for fields (by number): the last non-empty value of each in the islands, which are made once for all fields."""
    value = lambda islands, f: F.try_element_at(F.filter(islands, lambda x: (x["f"] == f) & (x["value"] != "")), F.lit(-1))["value"]
    return once(F.col(f"{name}_islands"), lambda islands: F.transform(numbers, lambda f: F.struct(f.alias("f"), value(islands, f).alias("value"))))


def parse_lines(labels: DataFrame, key: str = "label_id", text: str = "text") -> DataFrame:
    """key, field, value by the line parser: a label opens a field, other lines but noise go on it; the last non-empty one stays."""
    rows = _parsed(labels.select(key, F.col(text).alias("__text")), "__text", "__p")
    numbers = F.array_distinct(F.transform("__p_islands", lambda x: x["f"]))
    rows = rows.select(key, F.inline_outer(_last("__p", numbers)))
    names = F.array(*map(F.lit, FIELDS))
    return rows.where("value is not null").select(key, F.get(names, F.col("f")).alias("field"), "value")


def _of_field(f: Column, form) -> Column:
    """form(name) of the field with number f: a constant pattern each, compiled once; few values need one."""
    first, *rest = range(len(FIELDS))
    out = F.when(f == first, form(FIELDS[first]))
    for i in rest:
        out = out.when(f == i, form(FIELDS[i]))
    return out


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def strip_own_label(value: Column, f: Column) -> Column:
    """A clean value without the labels of its field f at the start, however often repeated."""
    cut = lambda name: F.regexp_replace(value, rf"(?iu)^(?:(?:{alternation(labels_of(name))}){_END}[ \t:=;|\-]*)+", "")
    return F.when(value.rlike(_START + _END), once(_of_field(f, cut), clean_value)).otherwise(value)


def search_text(text: Column, f: Column) -> Column:
    """The first alias of field f anywhere at a line's start, without a word boundary; white space may cross lines."""
    pattern = lambda name: rf"(?imu)^[{SPACE}]*(?:{alternation(own_aliases(name))})[{SPACE}]*[:=|;\-]?[{SPACE}]*([^\n]+?)[{SPACE}]*$"
    found = _of_field(f, lambda name: F.regexp_extract(F.replace(text, F.lit("\r"), F.lit(" ")), pattern(name), 1))
    return once(once(found, clean_value), _filled)


#: Every label of a field is an alias too, so the fields that a line may be of are those of its aliases.
assert all(set(labels_of(f)) == set(own_aliases(f)) for f in FIELDS)


def with_found(labels: DataFrame, text: str, name: str, fallback: bool = True) -> DataFrame:
    """labels with the array name of (f, value): the fields (by number) of the label that may have a value, "" if not, each once.

    fallback runs the two searches for fields that the line parser leaves empty (their quirks are kept: no word boundary in
    the second one): the first line with something after an alias, lines first, the longest alias first; then the text as a
    whole, which is searched only for fields with an alias at the start of a line.
    """
    p = f"__{name}"
    rows = _parsed(labels, text, p)

    def second(f):
        here = lambda x, i: F.transform(F.filter(x, lambda e: e["f"] == f), lambda e: value_after(F.get(f"{p}_lines", i), e["n"]))
        said = F.flatten(F.filter(F.transform(f"{p}_near", here), lambda x: x.isNotNull()))
        return F.coalesce(F.get(F.filter(said, lambda x: x != ""), F.lit(0)), search_text(F.col(text), f))

    numbers = F.col(f"{p}_loose") if fallback else F.array_distinct(F.transform(f"{p}_islands", lambda x: x["f"]))
    rows = rows.withColumn(f"{p}_last", _last(p, numbers))
    rows = rows.withColumn(f"{p}_first", F.transform(f"{p}_last", lambda x: F.struct(x["f"].alias("f"), once(once(x["value"], lambda v: strip_own_label(v, x["f"])), _filled).alias("value"))))
    found = F.transform(f"{p}_first", lambda x: F.struct(x["f"].alias("f"), F.coalesce(x["value"], F.lit("")).alias("value")))
    if fallback:
        own = lambda x: F.coalesce(once(second(x["f"]), lambda v: strip_own_label(v, x["f"])), F.lit(""))
        found = F.transform(f"{p}_first", lambda x: F.when(x["value"].isNotNull(), x).otherwise(F.struct(x["f"].alias("f"), own(x).alias("value"))))
    return rows.withColumn(name, found).select(*labels.columns, name)


def _value(name: str, f: Column) -> Column:
    return F.coalesce(F.get(F.filter(name, lambda x: x["f"] == f), F.lit(0))["value"], F.lit(""))


def _line_islands(rows: DataFrame, keys: tuple, *more: Column) -> DataFrame:
    """keys, island, f, value of the line parser: a label opens a field (island 0: lines before any), other lines but noise go on it."""
    first = F.get("near", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumn("__first", first).withColumn("island", F.sum(F.col("__first").isNotNull().cast("int")).over(order))
    part = F.when(F.col("__first").isNotNull(), F.nullif(F.col("__first.rest"), F.lit(""))).when(~is_noise(F.col("line")), F.col("line"))
    rows = rows.withColumn("__part", part)
    parts = F.array_sort(F.collect_list(F.when(F.col("__part").isNotNull(), F.struct("line_no", F.col("__part").alias("v")))))
    out = rows.groupBy(*keys, "island").agg(F.max("__first.f").alias("f"), parts.alias("parts"), *more)
    return out.withColumn("value", F.when(F.col("f").isNotNull(), clean_value(F.array_join(F.transform("parts", lambda p: p["v"]), " ")))).drop("parts")


def found_fields(labels: DataFrame, keys: tuple, text: str = "text", fallback: bool = True, by: tuple | None = None) -> DataFrame:
    """keys, f (number of a field), value, text: the fields of each label that may have a value ("" if not); the label's text is
    with one of its rows, and a label without fields has one row with null f.

    fallback runs the two searches for fields that the line parser leaves empty (their quirks are kept: no word boundary in
    the second one): the first line with something after an alias, lines first, the longest alias first; then the text as a
    whole, which is searched only for fields with an alias at the start of a line. by: those of keys that rows are shuffled by.
    """
    rows = explode_lines(labels.withColumn("__text", F.col(text)), (*keys, "__text"), text, outer=True)
    # the text travels with the first line alone
    rows = rows.withColumn("__text", F.when(F.coalesce("line_no", F.lit(0)) == 0, F.col("__text")))
    rows = line_starts(spread(rows, *(by or keys)))
    said = F.filter("near", lambda e: e["rest"] != "")
    seen = F.transform(said, lambda e: F.struct(e["f"].alias("f"), F.col("line_no").alias("line_no"), (-e["n"]).alias("before"), e["rest"].alias("rest")))
    islands = _line_islands(rows.withColumn("__seen", seen), keys, F.flatten(F.collect_list("__seen")).alias("seen"), F.flatten(F.collect_list("loose")).alias("loose"), F.max("__text").alias("text"))
    last = F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct((-F.col("island")).alias("i"), "f", "value"))))
    wide = islands.groupBy(*keys).agg(last.alias("last"), F.array_sort(F.flatten(F.collect_list("seen"))).alias("seen"), F.flatten(F.collect_list("loose")).alias("loose"), F.max("text").alias("text"))
    mine = lambda name, f, what: F.get(F.filter(name, lambda e: e["f"] == f), F.lit(0))[what]
    numbers = F.transform("last", lambda e: e["f"])
    if fallback:
        numbers = F.array_distinct(F.concat(numbers, F.transform("seen", lambda e: e["f"]), "loose"))
    cells = F.transform(F.array_distinct(numbers), lambda f: F.struct(f.alias("f"), mine("last", f, "value").alias("first"), mine("seen", f, "rest").alias("second")))
    rows = wide.select(*keys, "text", F.posexplode_outer(cells).alias("at", "c")).select(*keys, "text", "at", "c.*")
    rows = rows.withColumn("first", F.nullif(strip_own_label(F.col("first"), F.col("f")), F.lit("")))
    value = F.col("first")
    if fallback:
        rows = rows.withColumn("second", F.when(value.isNull(), F.coalesce("second", search_text(F.col("text"), F.col("f")))))
        value = F.coalesce(value, strip_own_label(F.col("second"), F.col("f")))
    return rows.select(*keys, "f", F.coalesce(value, F.lit("")).alias("value"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("text")).alias("text"))


def field_values(labels: DataFrame, keys: tuple, text: str = "text", fallback: bool = True, by: tuple | None = None) -> DataFrame:
    """keys, text, values: array of (field, field_ord, value) for all fields of every label; "" where none is found (see found_fields)."""
    rows = found_fields(labels, keys, text, fallback, by)
    found = F.map_from_entries(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "value"))))
    wide = rows.groupBy(*keys).agg(F.max("text").alias("text"), found.alias("found"))
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord")) for i, f in enumerate(FIELDS)])
    values = F.transform(each, lambda e: F.struct(e["field"].alias("field"), e["field_ord"].alias("field_ord"), F.coalesce(F.col("found")[e["field_ord"]], F.lit("")).alias("value")))
    return wide.select(*keys, "text", values.alias("values"))


def extract_fields(labels: DataFrame, key: str = "label_id", text: str = "text", fallback: bool = True) -> DataFrame:
    """key, field, field_ord, value for all fields of every label; "" where none is found."""
    rows = with_found(labels.select(key, F.col(text).alias("__text")), "__text", "__found", fallback)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord")) for i, f in enumerate(FIELDS)])
    values = F.transform(each, lambda e: F.struct(e["field"].alias("field"), e["field_ord"].alias("field_ord"), _value("__found", e["field_ord"]).alias("value")))
    return rows.select(key, F.inline_outer(values))


def with_sides(pairs: DataFrame, approval: str = "atext", sample: str = "stext", fallback: bool = True, every: bool = False) -> DataFrame:
    """pairs with the array fields of (field, field_ord, approval, sample): those that one side has, or all of them."""
    rows = with_found(with_found(pairs, approval, "__a", fallback), sample, "__s", fallback)
    name = lambda f: F.get(F.array(*map(F.lit, FIELDS)), f).alias("field")
    both = lambda f, a, s: F.struct(name(f), f.alias("field_ord"), a.alias("approval"), s.alias("sample"))
    number = lambda x: x["f"]
    met = lambda numbers: F.transform(numbers, lambda f: both(f, _value("__a", f), _value("__s", f)))
    if every:
        fields = met(F.array(*map(F.lit, range(len(FIELDS)))))
    else:
        alike = F.transform("__a", number) == F.transform("__s", number)
        fields = F.when(alike, F.zip_with("__a", "__s", lambda a, s: both(a["f"], a["value"], s["value"])))
        fields = fields.otherwise(met(F.array_distinct(F.concat(F.transform("__a", number), F.transform("__s", number)))))
        fields = F.filter(fields, lambda x: (x["approval"] != "") | (x["sample"] != ""))
    return rows.withColumn("fields", fields).drop("__a", "__s")


def extract_sides(pairs: DataFrame, key: str = "pair_id", approval: str = "atext", sample: str = "stext", fallback: bool = True, every: bool = True) -> DataFrame:
    """key, field, field_ord, approval, sample: the fields of both labels of each pair.

    every: all fields of every pair; else those alone that one side has.
    """
    return unnested(with_sides(pairs, approval, sample, fallback, every), "fields", key)
