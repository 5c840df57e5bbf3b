"""The label queries over the given tables, with the same results in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagsmith import fixtures as X
from tagsmith.functions import align, text as T
from tagsmith.functions.aliases import FIELDS, alternation, labels_of, own_aliases, owners
from tagsmith.functions.rounding import half_up
from tagsmith.operators import barcode, compare, fields, highlight, logo, ocr, report
from tagsmith.plans import label_qc
from tagsmith.sources import files

# --- SQL fragments -------------------------------------------------------------------------------------------

_SPACE = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_END = rf"([{_SPACE}]|[:=|;\-]|$)"


def _text(x: str) -> str:
    return f"coalesce(cast({x} AS varchar), '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


def _upper(x: str) -> str:
    return f"upper(replace({_text(x)}, 'ß', 'SS'))"


def _norm(x: str) -> str:
    return _squeeze(f"""translate({_upper(x)}, '—–−“”‘’|', '---""\'\'\'\'I')""")


def _key(x: str) -> str:
    return f"regexp_replace({_norm(x)}, '[^A-Z0-9]', '', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '{T.TOKEN}')"


def _numbers(x: str) -> str:
    return rf"regexp_extract_all({_text(x)}, '[0-9]+(?:\.[0-9]+)?')"


def _line(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(translate({_text(x)}, '—–−', '---'), '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g')")


def _clean(x: str) -> str:
    return _squeeze(rf"regexp_replace(regexp_replace({_line(x)}, '^[{_SPACE}:=;|,\-]+', ''), '[{_SPACE}:=;|]+$', '')")


def _label(x: str) -> str:
    return _squeeze(rf"regexp_replace(regexp_replace(translate({_strip(_upper(x))}, '—–_|', '--  '), '[.:;]+$', ''), '-+', ' ', 'g')")


def _lines(x: str, form) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({_text(x)}, '{_LINE_END}'), lambda l: {form('l')}), lambda l: l <> '')"


def _numeric(a: str, s: str) -> str:
    return f"CASE WHEN len({_numbers(a)}) = 0 THEN false WHEN len({_numbers(s)}) = 0 THEN true ELSE {_numbers(a)} <> {_numbers(s)} END"


def _values(rows) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_PAIRS = f"pairs AS ({X.LABEL_PAIRS_SQL})"
_OWNERS = f"owners(alias, field) AS (VALUES {_values(owners().items())})"
_EACH = f"each_alias(field, alias) AS (VALUES {_values([(f, a) for f in FIELDS for a in own_aliases(f)])})"
_ALTS = alternation(owners()).replace("'", "''")


def _side(name: str, col: str) -> str:
    """CTEs that extract the fields of one side: <name>(pair_id, field, value)."""
    p = name
    pattern = lambda f: rf"(?im)^[{_SPACE}]*(?:{alternation(own_aliases(f))})[{_SPACE}]*[:=|;\-]?[{_SPACE}]*([^\n]+?)[{_SPACE}]*$".replace("'", "''")
    second = ", ".join(f"{{'field': '{f}', 'ord': {i}, 'v': nullif({_clean(f'regexp_extract(t.{col}, {chr(39)}{pattern(f)}{chr(39)}, 1)')}, '')}}" for i, f in enumerate(FIELDS))
    # constant patterns, one per field, are compiled once
    own = lambda x: "CASE field " + " ".join(rf"WHEN '{f}' THEN regexp_replace({x}, '(?i)^(?:(?:{alternation(labels_of(f))})(?:[ \t:=;|\-]+|$))+', '')" for f in FIELDS) + " END"
    start = f"upper(regexp_extract(line, '(?i)^({_ALTS}){_END}', 1))"
    return f"""
{p}_lines AS (SELECT pair_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM (SELECT pair_id, {_lines(col, _line)} AS ls FROM pairs)),
{p}_start AS (SELECT l.*, o.field AS field, CASE WHEN o.field IS NOT NULL THEN {_clean("ltrim(substr(line, length(st) + 1))")} END AS rest
  FROM (SELECT *, {start} AS st FROM {p}_lines) l LEFT JOIN owners o ON o.alias = l.st),
{p}_isl AS (SELECT *, sum(CASE WHEN field IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY line_no) AS island FROM {p}_start),
{p}_val AS (SELECT pair_id, island, max(field) AS field, {_clean(f"coalesce(string_agg(CASE WHEN field IS NOT NULL THEN nullif(rest, '') WHEN length(regexp_replace(upper(line), '[^A-Z0-9]+', '', 'g')) > 1 THEN line END, ' ' ORDER BY line_no), '')")} AS value
  FROM {p}_isl WHERE island > 0 GROUP BY pair_id, island),
{p}_first AS (SELECT pair_id, field, arg_max(value, island) AS value FROM {p}_val WHERE value <> '' GROUP BY pair_id, field),
{p}_one AS (SELECT pair_id, field, arg_min(v, line_no * 1000 - length(alias)) AS v FROM (
    SELECT l.pair_id, l.line_no, e.field, e.alias, {_clean("ltrim(substr(l.line, length(e.alias) + 1))")} AS v
    FROM {p}_lines l JOIN each_alias e ON upper(substr(l.line, 1, length(e.alias))) = e.alias AND regexp_matches(substr(l.line, length(e.alias) + 1, 1), '^{_END}')) WHERE v <> '' GROUP BY pair_id, field),
{p}_second AS (SELECT pair_id, unnest([{second}]) AS w FROM pairs t),
{p}_raw AS (SELECT t.pair_id, t.w.field AS field, t.w.ord AS ord, {_clean("f.value")} AS a, {_clean("coalesce(o.v, t.w.v)")} AS b
  FROM {p}_second t LEFT JOIN {p}_first f ON f.pair_id = t.pair_id AND f.field = t.w.field LEFT JOIN {p}_one o ON o.pair_id = t.pair_id AND o.field = t.w.field),
{p} AS (SELECT pair_id, field, ord, {_clean(f"coalesce(nullif({_clean(own('a'))}, ''), {_clean(own('b'))}, '')")} AS value FROM {p}_raw)"""


#: Longest matching blocks by recursion: p(id, a, b) of non-empty strings -> ratio(id, ratio).
_RATIO = """
box(id, a, b, alo, ahi, blo, bhi, k) AS (
  SELECT id, a, b, 0, length(a), 0, length(b), 0 FROM p
  UNION ALL
  SELECT id, a, b, s.nalo, s.nahi, s.nblo, s.nbhi, s.k FROM (
    SELECT id, a, b, unnest([{'nalo': alo, 'nahi': m.i, 'nblo': blo, 'nbhi': m.j, 'k': m.k},
      {'nalo': m.i + m.k, 'nahi': ahi, 'nblo': m.j + m.k, 'nbhi': bhi, 'k': 0}]) AS s
    FROM (SELECT *, list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
        {'nk': -len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda q: substr(a, i::int + 1, q::int) = substr(b, j::int + 1, q::int))),
         'i': i::int, 'j': j::int}))))[1] AS mm FROM box WHERE alo < ahi AND blo < bhi) t,
      LATERAL (SELECT {'i': mm.i, 'j': mm.j, 'k': (-mm.nk)::int} AS m) WHERE mm.nk < 0)),
ratios AS (SELECT id, 2.0 * sum(k) / (length(any_value(a)) + length(any_value(b))) AS ratio FROM box GROUP BY id)"""

_FIELD_ROWS = f"""{_OWNERS}, {_EACH}, {_side("asd", "atext")}, {_side("ssd", "stext")},
joined AS (SELECT a.pair_id, a.field, a.ord, a.value AS approval, s.value AS sample FROM asd a JOIN ssd s USING (pair_id, field)),
keyed AS MATERIALIZED (SELECT *, {_key("approval")} AS ka, {_key("sample")} AS ks, {_numeric("approval", "sample")} AS num FROM joined),
p AS (SELECT row_number() OVER () AS id, ka AS a, ks AS b FROM (SELECT DISTINCT ka, ks FROM keyed WHERE approval <> '' AND sample <> '' AND ka <> ks AND ka <> '' AND ks <> '')),
{_RATIO},
scored AS (SELECT k.*, CASE WHEN ka = ks THEN 1.0 WHEN ka = '' OR ks = '' THEN 0.0 ELSE r.ratio END AS ratio
  FROM keyed k LEFT JOIN p ON p.a = k.ka AND p.b = k.ks LEFT JOIN ratios r ON r.id = p.id),
field_rows AS (SELECT pair_id, field, ord, approval, sample,
  CASE WHEN approval = '' AND sample = '' THEN 'NOT_CHECKED' WHEN sample = '' THEN 'MISSING' WHEN approval = '' THEN 'EXTRA'
    WHEN (ka <> '' AND ka = ks AND NOT num) OR (NOT num AND ratio >= 0.98) THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  CASE WHEN approval = '' AND sample = '' THEN NULL WHEN approval <> '' AND sample <> '' THEN round(ratio * 100, 2) ELSE 0.0 END AS score FROM scored)
"""
_COMPARED = f"WITH RECURSIVE {_PAIRS}, {_FIELD_ROWS}"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# --- text ----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_norm('text')} AS norm_text FROM documents")
def norm_text(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.compare_form(F.col("text")).alias("norm_text"))


@query(f"SELECT doc_id, {_key('text')} AS norm_key FROM documents")
def norm_key(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.key_form(F.col("text")).alias("norm_key"))


@query(f"SELECT doc_id, CAST(len({_tokens('text')}) AS int) AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents")
def tokens(spark, d):
    t = T.tokens(F.col("text"))
    return X.table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({_numbers('text')}, ' ') AS numbers FROM documents")
def numbers(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query(f"SELECT conv_id, turn, {_clean('text')} AS value FROM conversations")
def clean_value(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.clean_value(F.col("text")).alias("value"))


@query(f"SELECT p_partkey, {_label('p_name || ' + chr(39) + '_-' + chr(39) + ' || p_type || ' + chr(39) + ':.' + chr(39))} AS label FROM part")
def normalize_label(spark, d):
    return X.table(spark, d, "part").select("p_partkey", T.label_form(F.concat("p_name", F.lit("_-"), "p_type", F.lit(":."))).alias("label"))


@query(f"SELECT doc_id, CAST(len(ls) AS int) AS n_lines, CAST(len(list_filter(ls, lambda l: length(regexp_replace(upper(replace(l, 'ß', 'SS')), '[^A-Z0-9]+', '', 'g')) <= 1)) AS int) AS n_noise FROM (SELECT doc_id, {_lines('text', _line)} AS ls FROM documents)")
def noise_lines(spark, d):
    ls = T.lines(F.col("text"), T.line_form)
    return X.table(spark, d, "documents").select("doc_id", ls.alias("ls")).select("doc_id", F.size("ls").alias("n_lines"), F.size(F.filter("ls", T.is_noise)).alias("n_noise"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace({_strip(_upper('url'))}, '[{_SPACE}]+', '', 'g'), '[^A-Z0-9\-._/]+', '', 'g') AS barcode FROM pages")
def barcode_norm(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.barcode_form(F.col("url")).alias("barcode"))


@query(f"SELECT conv_id, turn, {_strip(chr(10).join(['regexp_replace(translate(' + _text('text') + ', chr(160) || ' + chr(39) + '—–−' + chr(39) + ', ' + chr(39) + ' ---' + chr(39) + '), ' + chr(39) + '[ ' + chr(92) + 't]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')']))} AS line, regexp_replace({_upper('text')}, '[^A-Z0-9]+', '', 'g') AS dup_key FROM conversations")
def ocr_line_norm(spark, d):
    c = F.col("text")
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.ocr_line(c).alias("line"), T.duplicate_key(c).alias("dup_key"))


@query(f"SELECT page_id, replace(replace(replace(replace(coalesce(nullif({_strip(_text('html'))}, ''), '-'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') AS cell FROM pages")
def pdf_escape(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.markup(F.col("html")).alias("cell"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '#DC3545' WHEN 'O' THEN '#198754' ELSE '#6C757D' END AS color FROM orders")
def status_color(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", " Pass ").otherwise(F.col("o_orderstatus"))
    return X.table(spark, d, "orders").select("o_orderkey", T.status_color(s).alias("color"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all({_text('text')}, '[A-Za-z0-9]+(?:[-./%][A-Za-z0-9]+)*'), ' ') AS words, regexp_replace({_squeeze('translate(' + _upper('text') + ', ' + chr(39) + '—–−_|' + chr(39) + ', ' + chr(39) + '----I' + chr(39) + ')')}, '[^A-Z0-9]', '', 'g') AS match_key FROM documents")
def highlight_forms(spark, d):
    c = F.col("text")
    return X.table(spark, d, "documents").select("doc_id", F.array_join(T.highlight_words(c), " ").alias("words"), T.highlight_key(c).alias("match_key"))


@query(r"SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([^.]*)$', 1)) IN ('png','jpg','jpeg','webp','pdf') AS allowed, concat(regexp_replace(url, '\.[^.]*$', ''), '_', substr(sha256(url), 1, 12), '.', lower(regexp_extract(url, '\.([^.]*)$', 1))) AS stored FROM pages")
def file_filter(spark, d):
    plain = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return X.table(spark, d, "pages").select("page_id", files.is_allowed(plain).alias("allowed"), files.unique_name(F.col("url"), F.col("url")).alias("stored"))


# --- pairs, fields -------------------------------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT pair_id, {_numeric('atext', 'stext')} AS numeric_difference, {_key('atext')} <> '' AND {_key('atext')} = {_key('stext')} AS tolerant_equal FROM pairs")
def pair_tests(spark, d):
    a, s = F.col("atext"), F.col("stext")
    return X.label_pairs(spark, d).select("pair_id", T.numeric_difference(a, s).alias("numeric_difference"), T.tolerant_equal(a, s).alias("tolerant_equal"))


@query(f"""WITH RECURSIVE names AS (SELECT s_suppkey AS id, {_key('s_name')} AS a, {_key('n_name')} AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT * FROM names WHERE a <> '' AND b <> ''), {_RATIO}
SELECT n.id AS s_suppkey, round(CASE WHEN n.a = n.b THEN 1.0 WHEN n.a = '' OR n.b = '' THEN 0.0 ELSE r.ratio END, 6) AS ratio FROM names n LEFT JOIN ratios r USING (id)""")
def similarity_ratio(spark, d):
    j = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select("s_suppkey", F.round(align.similarity(F.col("s_name"), F.col("n_name")), 6).alias("ratio"))


@query(f"WITH {_PAIRS}, {_OWNERS}, {_EACH}, {_side('asd', 'atext')} SELECT pair_id, CAST(line_no AS int) AS line_no, field, rest AS remainder FROM asd_start WHERE field IS NOT NULL")
def alias_match(spark, d):
    rows = fields.explode_lines(X.label_pairs(spark, d), "pair_id", "atext").withColumn("m", fields.match_start(F.col("line")))
    return rows.where("m is not null").select("pair_id", "line_no", "m.field", "m.remainder")


@query(f"WITH {_PAIRS}, {_OWNERS}, {_EACH}, {_side('asd', 'stext')} SELECT pair_id, field, value FROM asd_first")
def parse_fields(spark, d):
    return fields.parse_lines(X.label_pairs(spark, d), "pair_id", "stext")


@query(f"WITH {_PAIRS}, {_OWNERS}, {_EACH}, {_side('ssd', 'stext')} SELECT pair_id, field, ord AS field_ord, value FROM ssd")
def extract_fields(spark, d):
    return fields.extract_fields(X.label_pairs(spark, d), "pair_id", "stext")


@query(_COMPARED + "SELECT pair_id, field, approval, sample, status, score FROM field_rows WHERE status <> 'NOT_CHECKED'")
def compare_fields(spark, d):
    return label_qc.field_rows(X.label_pairs(spark, d), every=False).select("pair_id", "field", "approval", "sample", "status", "score")


_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for n, s in compare.STATUSES.items())


@query(_COMPARED + f"SELECT *, CASE WHEN total > 0 THEN round_even(matched / total, 4) ELSE 0.0 END AS field_score FROM (SELECT pair_id, {_COUNTS}, count(*) FILTER (status <> 'NOT_CHECKED') AS total FROM field_rows GROUP BY pair_id)")
def field_score(spark, d):
    return label_qc.field_scores(X.label_pairs(spark, d))


@query(_COMPARED + "SELECT field, status, count(*) AS n FROM field_rows GROUP BY ROLLUP (field, status)")
def mismatch_rollup(spark, d):
    return report.status_rollup(label_qc.field_rows(X.label_pairs(spark, d)))


@query(_COMPARED + "SELECT pair_id, field, status, replace(replace(replace(coalesce(nullif(approval, ''), '-'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS approval, replace(replace(replace(coalesce(nullif(sample, ''), '-'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS sample, CASE status WHEN 'MISMATCH' THEN '#DC3545' WHEN 'MISSING' THEN '#FD7E14' ELSE '#0D6EFD' END AS color FROM field_rows WHERE status IN ('MISMATCH', 'MISSING', 'EXTRA')")
def report_changes(spark, d):
    return report.detected_changes(label_qc.field_rows(X.label_pairs(spark, d), every=False))


# --- lines (alignment of lists: held against the standard library in tests) ---------------------------------


@query()
def line_align(spark, d):
    return compare.compare_lines(X.label_pairs(spark, d))


@query()
def line_diffs(spark, d):
    return compare.visual_diffs(compare.compare_lines(X.label_pairs(spark, d)))


@query()
def line_counts(spark, d):
    return compare.line_result(compare.compare_lines(X.label_pairs(spark, d)))


@query()
def line_mismatches(spark, d):
    return compare.line_mismatches(compare.compare_lines(X.label_pairs(spark, d)))


@query()
def highlight_boxes(spark, d):
    pairs = X.label_pairs(spark, d)
    diffs = compare.visual_diffs(compare.compare_lines(pairs))
    order = Window.partitionBy("pair_id").orderBy(F.coalesce("approval_line", "sample_line"), "type", "approval_text", "sample_text")
    diffs = diffs.withColumn("diff_no", F.row_number().over(order) - 1)
    sides = []
    for text in ("atext", "stext"):
        lines = pairs.select("pair_id", F.posexplode(T.lines(F.col(text))).alias("line_index", "line"))
        words = lines.select("pair_id", "line_index", F.posexplode(F.split("line", " ")).alias("word_index", "text"))
        sides.append(words.withColumns({"seq": F.expr("line_index * 1000 + word_index"), "x": F.expr("word_index * 60"), "y": F.expr("line_index * 40"), "w": F.expr("10 * length(text)"), "h": F.lit(20)}))
    return highlight.both_sides(diffs, *sides, F.lit(800), F.lit(1200))


@query()
def char_diffs(spark, d):
    p = X.label_pairs(spark, d)
    return p.select("pair_id", F.explode(align.char_diffs(F.col("atext"), F.col("stext"))).alias("c")).select("pair_id", "c.*")


@query()
def overall_status(spark, d):
    p = X.label_pairs(spark, d)
    picked = barcode.pick(X.barcodes(spark, d), "label_id", "side")
    bars = barcode.compare(picked.where("side = 0"), picked.where("side = 1")).select(F.col("label_id").alias("pair_id"), "status")
    return label_qc.pair_summary(p, barcode=bars)


@query()
def report_summary(spark, d):
    return report.sample_summary(label_qc.pair_summary(X.label_pairs(spark, d)))


@query()
def report_verification(spark, d):
    return report.verification(overall_status(spark, d))


# --- OCR -----------------------------------------------------------------------------------------------------

_WORDS = f"words AS ({X.LABEL_WORDS_DUCK})"
_GROUPS = f"""{_WORDS}, grp AS (SELECT label_id, block_num, par_num, line_num, min(y) AS min_y, min(x) AS min_x, min(seq) AS first_seq,
  {_squeeze(f"string_agg({_strip('text')}, ' ' ORDER BY x, seq) FILTER ({_strip('text')} <> '')")} AS text FROM words GROUP BY ALL)"""


@query(f"WITH {_GROUPS} SELECT label_id, string_agg(text, chr(10) ORDER BY min_y, min_x, first_seq) AS text FROM grp WHERE text <> '' GROUP BY label_id")
def ocr_line_text(spark, d):
    return ocr.build_text(X.label_words(spark, d))


@query(f"""WITH {_GROUPS}, idx AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY min_y, min_x, first_seq) - 1 AS line_index FROM grp WHERE text <> '')
SELECT label_id, seq, CAST(line_index AS int) AS line_index, CAST(row_number() OVER (PARTITION BY label_id, line_index ORDER BY x, seq) - 1 AS int) AS word_index
FROM words w JOIN idx i USING (label_id, block_num, par_num, line_num)""")
def ocr_line_index(spark, d):
    return ocr.index_words(X.label_words(spark, d)).select("label_id", "seq", "line_index", "word_index")


@query(f"""WITH {_WORDS}, m AS (SELECT label_id, seq, CAST(round_even(x * 1.5, 0) AS int) AS ox, CAST(round_even(y * 0.75, 0) AS int) AS oy, CAST(round_even(w * 1.5, 0) AS int) AS ow, CAST(round_even(h * 0.75, 0) AS int) AS oh FROM words),
c AS (SELECT label_id, seq, greatest(0, least(ox, 599)) AS ox, greatest(0, least(oy, 899)) AS oy, greatest(0, least(ox + ow, 600)) AS x2, greatest(0, least(oy + oh, 900)) AS y2 FROM m WHERE ow > 0 AND oh > 0)
SELECT label_id, seq, ox, oy, x2 - ox AS ow, y2 - oy AS oh, x2, y2 FROM c WHERE x2 > ox AND y2 > oy""")
def box_mapping(spark, d):
    return ocr.map_boxes(X.label_words(spark, d), F.lit(400), F.lit(1200), F.lit(600), F.lit(900)).select("label_id", "seq", "ox", "oy", "ow", "oh", "x2", "y2")


_SCORES = f"""{_WORDS}, per AS (SELECT label_id, string_agg(text, ' ' ORDER BY seq) AS text, count(*) AS n, coalesce(round(avg(confidence) FILTER (confidence > 0), 2), 0.0) AS confidence FROM words GROUP BY label_id),
sc AS (SELECT label_id, confidence, round(CASE WHEN {_strip('text')} = '' THEN 0.0 ELSE confidence + least(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / 20.0, 10.0) + least(n / 10.0, 5.0) END, 4) AS score FROM per)"""


def _scores(spark, d):
    words = X.label_words(spark, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ")
    per = words.groupBy("label_id").agg(text.alias("text"), F.count(F.lit(1)).alias("n")).join(ocr.mean_confidence(words), "label_id")
    return per.select("label_id", "confidence", half_up(ocr.score(F.col("text"), F.col("confidence"), F.col("n")), 4).alias("score"))


@query(f"WITH {_SCORES} SELECT * FROM sc")
def ocr_score(spark, d):
    return _scores(spark, d)


@query(f"WITH {_SCORES} SELECT label_id // 4 AS group_id, arg_max(label_id, score * 1000000 - label_id % 4) AS label_id, max(score) AS score FROM sc GROUP BY 1")
def best_variant(spark, d):
    rows = _scores(spark, d).select(F.expr("label_id div 4").alias("group_id"), "label_id", "score", (F.col("label_id") % 4).alias("variant_ord"))
    return ocr.best_candidate(rows, "group_id").select("group_id", "label_id", "score")


_MERGE = f"""ls AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS line_no FROM (SELECT doc_id, regexp_split_to_array({_text('text')}, '{_LINE_END}') AS l FROM documents)),
e AS (SELECT doc_id // 2 AS label_id, doc_id % 2 AS e, line_no, {_strip("regexp_replace(translate(text, chr(160) || '—–−', ' ---'), '[ " + chr(92) + "t]+', ' ', 'g')")} AS text FROM ls),
u AS (SELECT *, regexp_replace({_upper('text')}, '[^A-Z0-9]+', '', 'g') AS k FROM e WHERE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) >= 2),
f AS (SELECT *, row_number() OVER (PARTITION BY label_id, k ORDER BY e, line_no) AS i FROM u)"""


@query(f"WITH {_MERGE} SELECT label_id, CAST(row_number() OVER (PARTITION BY label_id ORDER BY e, line_no) - 1 AS int) AS line_no, text FROM f WHERE i = 1")
def merged_ocr(spark, d):
    rows = X.table(spark, d, "documents").select(F.expr("doc_id div 2").alias("label_id"), (F.col("doc_id") % 2).alias("e"), F.posexplode(F.split(F.coalesce("text", F.lit("")), T.LINE_END)).alias("line_no", "text"))
    return ocr.merge_lines(rows.where("e = 0"), rows.where("e = 1"))


@query()
def y_cluster_lines(spark, d):
    return ocr.cluster_lines(X.label_words(spark, d))


_RAW = """SELECT label_id, seq, CASE WHEN seq % 7 = 3 THEN '  ' WHEN seq % 5 = 0 THEN concat('  ', text, ' ') ELSE text END AS text,
  CASE WHEN seq % 11 = 4 THEN '-1' WHEN seq % 13 = 5 THEN 'n/a' ELSE cast(confidence AS varchar(20)) END AS confidence,
  CASE WHEN seq % 17 = 2 THEN '' ELSE cast(x AS varchar(20)) END AS x, cast(y AS varchar(20)) AS y, cast(w AS varchar(20)) AS w, cast(h AS varchar(20)) AS h FROM words"""


@query(f"""WITH {_WORDS}, raw AS ({_RAW}), n AS (SELECT label_id, seq, {_squeeze('text')} AS text, round(greatest(coalesce(try_cast(confidence AS double), 0.0), 0.0), 2) AS confidence, coalesce(try_cast(x AS int), 0) AS x, CAST(y AS int) AS y, CAST(w AS int) AS w, CAST(h AS int) AS h FROM raw)
SELECT *, x + w AS x2, y + h AS y2 FROM n WHERE text <> ''""")
def ocr_words_clean(spark, d):
    X.label_words(spark, d).createOrReplaceTempView("words")
    return ocr.clean_words(spark.sql(_RAW))


@query(f"""WITH {_WORDS}, raw AS (SELECT label_id, seq, text, confidence / 100 * 100 AS confidence, [x, x + w, x + w, x] AS xs, [y, y + 2, y + h + 2, y + h] AS ys FROM words),
b AS (SELECT label_id, seq, {_squeeze('text')} AS text, round(confidence, 2) AS confidence, list_min(xs) AS x, list_min(ys) AS y, list_max(xs) AS x2, list_max(ys) AS y2 FROM raw WHERE confidence >= 25)
SELECT *, x2 - x AS w, y2 - y AS h FROM b WHERE text <> ''""")
def ocr_region_words(spark, d):
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    box = F.array(corner("x", "y"), corner("x + w", "y + 2"), corner("x + w", "y + h + 2"), corner("x", "y + h"))
    return ocr.region_words(X.label_words(spark, d).select("label_id", "seq", "text", (F.col("confidence") / 100).alias("confidence"), box.alias("box")))


@query(f"""WITH {_WORDS}, per AS (SELECT label_id, coalesce(round(avg(confidence) FILTER (confidence > 0), 2), 0.0) AS a, coalesce(round(avg(confidence) FILTER (confidence > 0 AND seq % 2 = 0), 2), 0.0) AS b FROM words GROUP BY label_id),
e AS (SELECT label_id, CASE WHEN label_id % 3 <> 0 THEN a END AS a, CASE WHEN label_id % 2 = 0 THEN b END AS b FROM per WHERE label_id % 3 <> 0 OR label_id % 2 = 0)
SELECT label_id, CASE WHEN a IS NOT NULL THEN 'tesseract' ELSE 'easyocr' END AS engine, round_even(CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE 0.0 END, 1) AS confidence FROM e""")
def engine_choice(spark, d):
    words = X.label_words(spark, d)
    return ocr.choose_engine(words.where("label_id % 3 <> 0"), words.where("label_id % 2 = 0 and seq % 2 = 0"))


@query(ORACLE_SQL["pdf_escape"].replace("FROM pages", f"FROM pages WHERE {_strip(_text('html'))} <> ''"))
def report_ocr_text(spark, d):
    return report.ocr_text(X.table(spark, d, "pages"), "page_id", "html")


# --- logo ----------------------------------------------------------------------------------------------------

_PIX = f"pix AS ({X.LABEL_PIXELS_DUCK})"
_LOGO = f"""{_PIX}, cont AS (SELECT image_id, stddev_pop(v) AS std, avg(edge) AS edge_ratio, stddev_pop(v) >= 8.0 AND avg(edge) >= 0.015 AS ok FROM pix GROUP BY image_id),
pr AS (SELECT image_id AS pair_id, image_id AS a_id, image_id + 1 + image_id % 3 - 1 - (image_id % 3 = 0)::int + (image_id % 3 = 0)::int AS b_id FROM cont),
px AS (SELECT pair_id, 1 - avg(abs(a.v - b.v)) / 255 AS pixel, CASE WHEN sum(greatest(a.edge, b.edge)) > 0 THEN sum(a.edge * b.edge) / sum(greatest(a.edge, b.edge)) ELSE 0.0 END AS structure
  FROM pr JOIN pix a ON a.image_id = a_id JOIN pix b ON b.image_id = b_id AND a.y = b.y AND a.x = b.x GROUP BY pair_id),
hc AS (SELECT image_id, v // 4 AS bin, count(*) AS n FROM pix GROUP BY ALL),
hs AS (SELECT pair_id, corr(coalesce(x.n, 0), coalesce(y.n, 0)) AS r FROM pr CROSS JOIN range(64) g(bin) LEFT JOIN hc x ON x.image_id = a_id AND x.bin = g.bin LEFT JOIN hc y ON y.image_id = b_id AND y.bin = g.bin GROUP BY pair_id),
lg AS (SELECT pr.pair_id, pixel, structure, CASE WHEN r IS NULL OR isnan(r) THEN 0.5 ELSE greatest(0.0, least(1.0, (r + 1) / 2)) END AS histogram, ca.ok AS aok, cb.ok AS bok
  FROM pr LEFT JOIN px USING (pair_id) LEFT JOIN hs USING (pair_id) LEFT JOIN cont ca ON ca.image_id = a_id LEFT JOIN cont cb ON cb.image_id = b_id),
sim AS (SELECT *, greatest(0.0, least(1.0, 0.2 * pixel + 0.2 * histogram + 0.6 * structure)) AS similarity FROM lg)"""


def _logo(spark, d):
    pix = X.label_pixels(spark, d)
    ids = pix.select("image_id").distinct()
    pairs = ids.select(F.col("image_id").alias("pair_id"), F.col("image_id").alias("a_id"), (F.col("image_id") + F.col("image_id") % 3).alias("b_id"))
    return logo.compare(pairs, pix, pix)


@query(f"WITH {_PIX} SELECT image_id, round(stddev_pop(v), 6) AS std, round(avg(edge), 6) AS edge_ratio, stddev_pop(v) >= 8.0 AND avg(edge) >= 0.015 AS has_content FROM pix GROUP BY image_id")
def visual_content(spark, d):
    return logo.content(X.label_pixels(spark, d), "image_id").select("image_id", F.round("std", 6).alias("std"), F.round("edge_ratio", 6).alias("edge_ratio"), "has_content")


@query(f"WITH {_LOGO} SELECT pair_id, round(pixel, 6) AS pixel, round(histogram, 6) AS histogram, round(structure, 6) AS structure FROM sim WHERE pixel IS NOT NULL")
def logo_similarities(spark, d):
    return _logo(spark, d).where("pixel is not null").select("pair_id", *[F.round(c, 6).alias(c) for c in ("pixel", "histogram", "structure")])


@query(f"""WITH {_LOGO} SELECT pair_id, CASE WHEN aok IS NULL OR bok IS NULL OR NOT aok THEN 'NOT_FOUND' WHEN NOT bok THEN 'FAIL' WHEN similarity <= 0 THEN 'NOT_FOUND' WHEN similarity >= 0.72 THEN 'PASS' ELSE 'FAIL' END AS status FROM sim""")
def logo_status(spark, d):
    return _logo(spark, d).select("pair_id", "status")


@query(f"""WITH {_PIX}, big AS (SELECT image_id // 16 AS image_id, (image_id % 16) // 4 * 8 + y AS y, image_id % 4 * 8 + x AS x, v, edge FROM pix),
r(region, y1, y2, x1, x2) AS (VALUES (0, 0, 9, 0, 14), (1, 0, 11, 0, 19), (2, 0, 9, 4, 22))
SELECT image_id, region, CAST(count(*) AS bigint) AS n, CAST(sum(v) AS bigint) AS total, max(y - y1) AS max_y, max(x - x1) AS max_x FROM big JOIN r ON y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
def region_crop(spark, d):
    pix = X.label_pixels(spark, d)
    big = pix.select(F.expr("image_id div 16").alias("image_id"), F.expr("(image_id % 16) div 4 * 8 + y").alias("y"), F.expr("image_id % 4 * 8 + x").alias("x"), "v", "edge")
    return logo.regions(big, 32, 32).groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("y").alias("max_y"), F.max("x").alias("max_x"))


@query()
def logo_region_status(spark, d):
    pix = X.label_pixels(spark, d)
    big = pix.select(F.expr("image_id div 16").alias("image_id"), F.expr("(image_id % 16) div 4 * 8 + y").alias("y"), F.expr("image_id % 4 * 8 + x").alias("x"), "v", "edge")
    ids = big.select("image_id").distinct()
    pairs = ids.select(F.col("image_id").alias("pair_id"), F.col("image_id").alias("a_id"), (F.col("image_id") + F.col("image_id") % 3).alias("b_id"))
    return logo.compare_regions(pairs, big, big, grid=(36, 60)).drop("similarity")


# --- barcode, highlight --------------------------------------------------------------------------------------

_BARS = rf"""cand AS (SELECT *, CASE WHEN detected THEN regexp_replace(regexp_replace(upper(trim(decoded)), '[{_SPACE}]+', '', 'g'), '[^A-Z0-9\-._/]+', '', 'g') ELSE '' END AS val FROM ({X.BARCODES_SQL})),
bst AS (SELECT label_id, side, arg_min(CASE WHEN val <> '' THEN 0 WHEN detected THEN 1 ELSE 2 END, ord) AS rank, arg_min(val, ord) AS val, max(CASE state WHEN 'ERROR' THEN 2 WHEN 'NOT_CHECKED' THEN 1 ELSE 0 END) AS bad
  FROM (SELECT *, (CASE WHEN val <> '' THEN 0 WHEN detected THEN 1 ELSE 2 END) * 10 + variant_ord AS ord FROM cand) GROUP BY ALL),
picked AS (SELECT label_id, side, CASE WHEN bad = 2 THEN 'ERROR' WHEN bad = 1 THEN 'NOT_CHECKED' WHEN rank = 0 THEN 'DETECTED' WHEN rank = 1 THEN 'DETECTED_NOT_DECODED' ELSE 'NOT_FOUND' END AS status, CASE WHEN bad > 0 THEN '' ELSE val END AS value FROM bst)"""


@query(f"WITH {_BARS} SELECT label_id, side, status, value FROM picked")
def barcode_pick(spark, d):
    return barcode.pick(X.barcodes(spark, d), "label_id", "side")


@query(f"""WITH {_BARS}, j AS (SELECT label_id, a.status AS a, s.status AS s, a.value AS av, s.value AS sv FROM (SELECT * FROM picked WHERE side = 0) a JOIN (SELECT * FROM picked WHERE side = 1) s USING (label_id))
SELECT label_id, CASE WHEN a IN ('ERROR', 'NOT_CHECKED') OR s IN ('ERROR', 'NOT_CHECKED') THEN 'NOT_CHECKED' WHEN a = 'NOT_FOUND' AND s = 'NOT_FOUND' THEN 'NOT_FOUND'
  WHEN a = 'NOT_FOUND' OR s = 'NOT_FOUND' THEN 'FAIL' WHEN av = '' AND sv = '' THEN 'DETECTED_NOT_DECODED' WHEN av = '' OR sv = '' THEN 'NOT_CHECKED' WHEN av = sv THEN 'PASS' ELSE 'FAIL' END AS status,
  av AS approval_value, sv AS sample_value FROM j""")
def barcode_compare(spark, d):
    p = barcode.pick(X.barcodes(spark, d), "label_id", "side")
    return barcode.compare(p.where("side = 0"), p.where("side = 1"))


@query(f"""WITH {_WORDS}, b AS (SELECT label_id, seq, greatest(0, least(x - 3, 399)) AS x1, greatest(0, least(y - 3, 1199)) AS y1, greatest(0, least(x + w + 3, 399)) AS x2, greatest(0, least(y + h + 3, 1199)) AS y2 FROM words WHERE w > 0 AND h > 0)
SELECT * FROM b WHERE x2 > x1 AND y2 > y1""")
def safe_boxes(spark, d):
    return highlight.safe_boxes(X.label_words(spark, d), F.lit(400), F.lit(1200)).select("label_id", "seq", "x1", "y1", "x2", "y2")


@query()
def word_match_boxes(spark, d):
    words = ocr.index_words(X.label_words(spark, d))
    targets = words.select("label_id", "line_index", F.col("word_index").alias("target_no"), F.col("text").alias("target"))
    return highlight.find_words(targets, words).select("label_id", "line_index", "target_no", "target", "word_index", "fit")
