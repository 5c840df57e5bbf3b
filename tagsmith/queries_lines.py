"""SQL of the line comparison and what rests on it, and the queries of approvals with many samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagsmith import fixtures as X
from tagsmith.functions import text as T
from tagsmith.operators import barcode, groups
from tagsmith.plans import label_qc
from tagsmith.queries import _BARS, _COUNTS, _LOGO, _FIELD_ROWS, _PAIRS, ORACLE_SQL, QUERIES, _key, _lines, _norm, _squeeze, _upper, query


def _blocks(name: str) -> str:
    """<name>_gap(id, i, j, k, pi, pj) of <name>_p(id, a, b), lists: matching blocks by recursion (longest first, earliest of equals), each with the ends of the one before."""
    return f"""
{name}_box(id, a, b, alo, ahi, blo, bhi, k) AS (
  SELECT id, a, b, 0, len(a)::int, 0, len(b)::int, 0 FROM {name}_p
  UNION ALL
  SELECT id, a, b, s.nalo, s.nahi, s.nblo, s.nbhi, s.k FROM (
    SELECT id, a, b, unnest([{{'nalo': alo, 'nahi': m.i, 'nblo': blo, 'nbhi': m.j, 'k': m.k}}, {{'nalo': m.i + m.k, 'nahi': ahi, 'nblo': m.j + m.k, 'nbhi': bhi, 'k': 0}}]) AS s
    FROM (SELECT *, list_sort(flatten(list_transform(range(alo, ahi), lambda i: list_transform(list_filter(range(blo, bhi), lambda j: a[i::int + 1] = b[j::int + 1]), lambda j:
        {{'nk': -len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda q: a[i::int + 1 : (i + q)::int] = b[j::int + 1 : (j + q)::int])), 'i': i::int, 'j': j::int}}))))[1] AS mm
      FROM {name}_box WHERE alo < ahi AND blo < bhi) t, LATERAL (SELECT {{'i': mm.i, 'j': mm.j, 'k': (-mm.nk)::int}} AS m) WHERE mm.nk < 0)),
{name}_blk AS (SELECT id, ahi AS i, bhi AS j, k FROM {name}_box WHERE k > 0 UNION ALL SELECT id, len(a), len(b), 0 FROM {name}_p),
{name}_gap AS MATERIALIZED (SELECT *, coalesce(lag(i + k) OVER w, 0) AS pi, coalesce(lag(j + k) OVER w, 0) AS pj FROM {name}_blk WINDOW w AS (PARTITION BY id ORDER BY i, j))"""


def _line_rows(pairs: str = "pairs") -> str:
    """CTEs to line_rows(pair_id, approval_line, sample_line, approval, sample, status, line)."""
    return f"""
sides AS MATERIALIZED (SELECT pair_id, {_lines('atext', _norm)} AS a, {_lines('stext', _norm)} AS b FROM {pairs}),
l_p AS MATERIALIZED (SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT a, b FROM sides)),{_blocks('l')},
l_seg AS (SELECT id, true AS same, i + q AS ai, j + q AS sj FROM (SELECT *, unnest(range(k)) AS q FROM l_gap)
  UNION ALL SELECT id, false, CASE WHEN pi + q < i THEN pi + q END, CASE WHEN pj + q < j THEN pj + q END FROM (SELECT *, unnest(range(greatest(i - pi, j - pj))) AS q FROM l_gap)),
l_row AS MATERIALIZED (SELECT id, same, CAST(ai AS int) AS approval_line, CAST(sj AS int) AS sample_line, coalesce(a[ai + 1], '') AS approval, coalesce(b[sj + 1], '') AS sample FROM l_seg JOIN l_p USING (id)),
l_stat AS (SELECT *, CASE WHEN same THEN 'MATCH' WHEN sample_line IS NULL THEN 'MISSING' WHEN approval_line IS NULL THEN 'EXTRA' WHEN {_key('approval')} <> '' AND {_key('approval')} = {_key('sample')} THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM l_row),
line_rows AS (SELECT s.pair_id, approval_line, sample_line, approval, sample, status, coalesce(approval_line, sample_line) + 1 AS line FROM sides s JOIN l_p ON l_p.a = s.a AND l_p.b = s.b JOIN l_stat USING (id))"""


_TOKENS = lambda c: f"regexp_extract_all({c}, '{T.TOKEN}')"
_DIFFS = f"""
t_p AS MATERIALIZED (SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT {_TOKENS('approval')} AS a, {_TOKENS('sample')} AS b FROM line_rows WHERE status = 'MISMATCH')),{_blocks('t')},
t_diff AS (SELECT a, b, CASE WHEN pi < i AND pj < j THEN 'replace' WHEN pi < i THEN 'delete' ELSE 'insert' END AS type, array_to_string(a[pi + 1 : i], ' ') AS approval_text, array_to_string(b[pj + 1 : j], ' ') AS sample_text FROM t_gap JOIN t_p USING (id) WHERE pi < i OR pj < j),
visual AS (SELECT pair_id, CASE status WHEN 'MISSING' THEN 'delete' ELSE 'insert' END AS type, array_to_string({_TOKENS('approval')}, ' ') AS approval_text, array_to_string({_TOKENS('sample')}, ' ') AS sample_text, approval_line, sample_line FROM line_rows WHERE status IN ('MISSING', 'EXTRA')
  UNION ALL SELECT pair_id, type, approval_text, sample_text, approval_line, sample_line FROM line_rows l JOIN t_diff d ON d.a = {_TOKENS('l.approval')} AND d.b = {_TOKENS('l.sample')} WHERE status = 'MISMATCH')"""

_LINE_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for n, s in (("matched", "MATCH"), ("mismatched", "MISMATCH"), ("missing", "MISSING"), ("extra", "EXTRA")))
_RESULTS = f"""
f_res AS (SELECT *, CASE WHEN total > 0 THEN round_even(matched / total, 4) ELSE 0.0 END AS field_score FROM (SELECT pair_id, {_COUNTS}, count(*) FILTER (status <> 'NOT_CHECKED') AS total FROM field_rows GROUP BY pair_id)),
l_res AS (SELECT *, round_even(matched / total, 4) AS score FROM (SELECT pair_id, {_LINE_COUNTS}, count(*) AS total FROM line_rows GROUP BY pair_id))"""


def _summary(bars: str | None, logos: str | None = None) -> str:
    """CTE pair_summary from f_res and l_res; bars and logos: tables (pair_id, status) of barcode and logo verdicts."""
    pick = lambda f, t: f"coalesce(CASE WHEN f.total > 0 THEN f.{f} ELSE t.{t} END, 0)"
    line = lambda c: f"coalesce(CASE WHEN f.total > 0 THEN t.{c} END, 0)"
    status = lambda t, alias: f"upper({alias}.status)" if t else "CAST(NULL AS varchar)"
    join = lambda t, alias: f"LEFT JOIN {t} {alias} USING (pair_id)" if t else ""
    return f"""
merged AS (SELECT pair_id, {status(logos, 'g')} AS logo_status, {status(bars, 'b')} AS barcode_status, {', '.join(f'{pick(c, c)} AS {c}' for c in ('matched', 'mismatched', 'missing', 'extra', 'total'))},
    coalesce(CASE WHEN f.total > 0 THEN f.not_checked END, 0) AS not_checked, {pick('field_score', 'score')} AS field_score, {', '.join(f'{line(c)} AS line_{c}' for c in ('mismatched', 'missing', 'extra'))}
  FROM pairs p LEFT JOIN f_res f USING (pair_id) LEFT JOIN l_res t USING (pair_id) {join(logos, 'g')} {join(bars, 'b')}),
weighed AS (SELECT *, CASE WHEN total > 0 OR logo_status IN ('PASS', 'FAIL') OR barcode_status IN ('PASS', 'FAIL')
  THEN (CASE WHEN total > 0 THEN field_score * 0.85::double ELSE 0.0 END + CASE WHEN logo_status = 'PASS' THEN 0.10::double ELSE 0.0 END + CASE WHEN barcode_status = 'PASS' THEN 0.05::double ELSE 0.0 END)
    / (CASE WHEN total > 0 THEN 0.85::double ELSE 0.0 END + CASE WHEN logo_status IN ('PASS', 'FAIL') THEN 0.10::double ELSE 0.0 END + CASE WHEN barcode_status IN ('PASS', 'FAIL') THEN 0.05::double ELSE 0.0 END) ELSE 0.0 END AS f FROM merged),
pair_summary AS (SELECT * EXCLUDE (f), round_even(f, 4) AS score_fraction, round_even(f * 100, 1) AS score, CASE WHEN mismatched + missing + extra + line_mismatched + line_missing + line_extra > 0 OR coalesce(logo_status = 'FAIL', false) OR coalesce(barcode_status = 'FAIL', false) OR f < 0.9 THEN 'FAIL' ELSE 'PASS' END AS status FROM weighed)"""


def _hkey(x: str) -> str:
    return f"regexp_replace({_squeeze('translate(' + _upper(x) + ', ' + chr(39) + '—–−_|' + chr(39) + ', ' + chr(39) + '----I' + chr(39) + ')')}, '[^A-Z0-9]', '', 'g')"


def _words_of(side: str, col: str) -> str:
    return f"SELECT pair_id, '{side}' AS side, CAST(line AS int) AS line, CAST(wi AS int) AS wi, word, {_hkey('word')} AS wk FROM (SELECT pair_id, line, unnest(ws) AS word, unnest(range(len(ws))) AS wi FROM (SELECT pair_id, line, string_split(l, ' ') AS ws FROM (SELECT pair_id, unnest({col}) AS l, unnest(range(len({col}))) AS line FROM sides)))"


def _targets_of(side: str) -> str:
    return f"SELECT pair_id, '{side}' AS side, diff_no, type, {side}_line AS line, target, {_hkey('target')} AS tk, tn FROM (SELECT *, unnest(string_split({side}_text, ' ')) AS target, unnest(range(len(string_split({side}_text, ' ')))) AS tn FROM numbered)"


#: Targets of a difference choose among their line's words one after the other.
_BOXES = f"""
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(approval_line, sample_line), type, approval_text, sample_text) - 1 AS diff_no FROM visual),
hw AS ({_words_of('approval', 'a')} UNION ALL {_words_of('sample', 'b')}), hl AS MATERIALIZED (SELECT pair_id, side, line, list({{'wi': wi, 'word': word, 'wk': wk}} ORDER BY wi) AS ws FROM hw WHERE wk <> '' GROUP BY ALL),
ht AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pair_id, side, diff_no ORDER BY tn) AS n FROM ({_targets_of('approval')} UNION ALL {_targets_of('sample')}) WHERE tk <> ''),
pick(pair_id, side, diff_no, n, taken, best) AS (SELECT DISTINCT pair_id, side, diff_no, 0::bigint, []::bigint[], NULL::bigint FROM ht
  UNION ALL SELECT pair_id, side, diff_no, n, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.i) END, b.i FROM (
    SELECT p.pair_id, p.side, p.diff_no, t.n, p.taken, list_sort(list_filter(list_transform(range(1, len(ws) + 1), lambda i: {{'fit': CASE WHEN ws[i].wk = t.tk THEN -2 WHEN length(t.tk) >= 3 AND (contains(ws[i].wk, t.tk) OR contains(t.tk, ws[i].wk)) THEN -1 ELSE 0 END, 'i': i}}), lambda s: s.fit < 0 AND NOT list_contains(p.taken, s.i)))[1] AS b
    FROM pick p JOIN ht t ON t.pair_id = p.pair_id AND t.side = p.side AND t.diff_no = p.diff_no AND t.n = p.n + 1 JOIN hl ON hl.pair_id = t.pair_id AND hl.side = t.side AND hl.line = t.line)),
drawn AS (SELECT side, pair_id, diff_no, target, type, line, ws[best].wi AS wi, ws[best].word AS word FROM pick JOIN ht USING (pair_id, side, diff_no, n) JOIN hl USING (pair_id, side, line) WHERE best IS NOT NULL),
hb AS (SELECT *, greatest(0, least(wi * 60 - 3, 799)) AS x1, greatest(0, least(line * 40 - 3, 1199)) AS y1, greatest(0, least(wi * 60 + 10 * length(word) + 3, 799)) AS x2, greatest(0, least(line * 40 + 23, 1199)) AS y2 FROM drawn)"""


_LINES = f"WITH RECURSIVE {_PAIRS}, {_line_rows()}"
_VERDICT = f"WITH RECURSIVE {_PAIRS}, {_FIELD_ROWS}, {_line_rows()}, {_RESULTS}"
_BARCODES = f"""{_BARS},
bar AS (SELECT label_id AS pair_id, CASE WHEN a IN ('ERROR', 'NOT_CHECKED') OR s IN ('ERROR', 'NOT_CHECKED') THEN 'NOT_CHECKED' WHEN a = 'NOT_FOUND' AND s = 'NOT_FOUND' THEN 'NOT_FOUND' WHEN a = 'NOT_FOUND' OR s = 'NOT_FOUND' THEN 'FAIL'
    WHEN av = '' AND sv = '' THEN 'DETECTED_NOT_DECODED' WHEN av = '' OR sv = '' THEN 'NOT_CHECKED' WHEN av = sv THEN 'PASS' ELSE 'FAIL' END AS status
  FROM (SELECT label_id, a.status AS a, s.status AS s, a.value AS av, s.value AS sv FROM (SELECT * FROM picked WHERE side = 0) a JOIN (SELECT * FROM picked WHERE side = 1) s USING (label_id)))"""
_COLOR = "CASE status WHEN 'PASS' THEN '#198754' ELSE '#DC3545' END AS color"

ORACLE_SQL |= {
    "line_align": f"{_LINES} SELECT pair_id, approval_line, sample_line, approval, sample, status, line FROM line_rows",
    "line_counts": f"{_LINES} SELECT *, round_even(matched / total, 4) AS score FROM (SELECT pair_id, {_LINE_COUNTS}, count(*) AS total FROM line_rows GROUP BY pair_id)",
    "line_mismatches": f"{_LINES} SELECT pair_id, concat('LINE ', CAST(line AS varchar)) AS field, approval, sample, status, CAST(NULL AS double) AS score FROM line_rows WHERE status <> 'MATCH'",
    "line_diffs": f"{_LINES}, {_DIFFS} SELECT * FROM visual",
    "highlight_boxes": f"""{_LINES}, {_DIFFS}, {_BOXES} SELECT side, pair_id, CAST(diff_no AS int) AS diff_no, target, CASE WHEN side = 'approval' AND type = 'delete' THEN 'ORANGE' WHEN side = 'sample' AND type = 'insert' THEN 'BLUE' ELSE 'RED' END AS color,
  CASE WHEN side = 'approval' AND type = 'delete' THEN 'MISSING' WHEN side = 'sample' AND type = 'insert' THEN 'EXTRA' ELSE 'CHANGE' END AS label, x1, y1, CAST(x2 AS int) AS x2, y2 FROM hb WHERE x2 > x1 AND y2 > y1""",
    "report_summary": f"{_VERDICT}, {_summary(None)} SELECT pair_id, score AS score_percent, status AS result, matched, mismatched, missing, extra, not_checked, {_COLOR} FROM pair_summary",
    "overall_status": f"{_VERDICT}, {_BARCODES}, {_summary('bar')} SELECT * FROM pair_summary",
    "report_verification": f"{_VERDICT}, {_BARCODES}, {_summary('bar')} SELECT pair_id, unnest(['Logo', 'Barcode']) AS \"check\", unnest([coalesce(logo_status, 'NOT_CHECKED'), coalesce(barcode_status, 'NOT_CHECKED')]) AS result FROM pair_summary",
}


@query(f"""{_VERDICT}, {_BARCODES}, {_LOGO}, lg AS (SELECT pair_id, CASE WHEN aok IS NULL OR bok IS NULL OR NOT aok THEN 'NOT_FOUND' WHEN NOT bok THEN 'FAIL' WHEN similarity <= 0 THEN 'NOT_FOUND' WHEN similarity >= 0.72 THEN 'PASS' ELSE 'FAIL' END AS status FROM sim),
{_summary('bar', 'lg')} SELECT pair_id, logo_status, barcode_status, score, score_fraction, status FROM pair_summary""".replace("lg AS (SELECT pr.pair_id", "lgs AS (SELECT pr.pair_id").replace("FROM lg)", "FROM lgs)"))
def pair_verdict(spark, d):
    """Fields, lines, barcode and logo of each pair: pairs without images or codes are weighed without them."""
    picked = barcode.pick(X.barcodes(spark, d), "label_id", "side")
    bars = barcode.compare(picked.where("side = 0"), picked.where("side = 1")).select(F.col("label_id").alias("pair_id"), "status")
    logos = QUERIES["logo_status"](spark, d)
    return label_qc.pair_summary(X.label_pairs(spark, d), logo=logos, barcode=bars).select("pair_id", "logo_status", "barcode_status", "score", "score_fraction", "status")


# --- approvals with many samples -----------------------------------------------------------------------------

_GROUPS = f"""WITH RECURSIVE appr AS ({X.APPROVALS_SQL}), samp AS ({X.SAMPLES_SQL}), pairs AS (SELECT sample_no AS pair_id, s.group_id, a.text AS atext, s.text AS stext FROM samp s JOIN appr a USING (group_id)),
{_FIELD_ROWS}, {_line_rows()}, {_RESULTS}, {_summary(None)}"""


@query(f"""{_GROUPS}, {_DIFFS},
nf AS (SELECT pair_id, string_agg(concat(field, '=', status, CASE WHEN score IS NULL THEN '' ELSE concat('@', CAST(CAST(round(score) AS int) AS varchar)) END), ';' ORDER BY ord) AS fields FROM field_rows WHERE status <> 'NOT_CHECKED' GROUP BY pair_id),
nl AS (SELECT pair_id, string_agg(concat(CAST(line AS varchar), status), ';' ORDER BY line, coalesce(approval_line, -1), coalesce(sample_line, -1)) AS lines FROM line_rows GROUP BY pair_id),
nd AS (SELECT pair_id, string_agg(concat(type, ':', approval_text, '>', sample_text), ';' ORDER BY coalesce(approval_line, sample_line), coalesce(approval_line, -1), coalesce(sample_line, -1), type, approval_text, sample_text) AS differences FROM visual GROUP BY pair_id),
recs AS (SELECT group_id, s.pair_id // 100 AS page, count(*) AS n, count(*) FILTER (s.status = 'PASS') AS passed,
    string_agg(concat(CAST(s.pair_id AS varchar), ' ', s.status, ' ', CAST(CAST(s.score * 10 AS int) AS varchar), ' [', coalesce(fields, ''), '] [', coalesce(lines, ''), '] [', coalesce(differences, ''), ']'), chr(10) ORDER BY s.pair_id) AS samples
  FROM pair_summary s JOIN pairs USING (pair_id) LEFT JOIN nf USING (pair_id) LEFT JOIN nl USING (pair_id) LEFT JOIN nd USING (pair_id) GROUP BY ALL)
SELECT group_id, coalesce(page, 0) AS page, text AS approval_text, coalesce(n, 0) AS samples_count, coalesce(passed, 0) AS passed, coalesce(samples, '') AS samples FROM appr LEFT JOIN recs USING (group_id)""")
def approval_results(spark, d):
    approvals = groups.read_fields(X.approvals(spark, d), ("group_id",))
    records = groups.result_records(approvals, groups.sample_results(groups.group_pairs(approvals, X.samples(spark, d))))
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    field = lambda r: F.concat(r["field"], F.lit("="), r["status"], F.coalesce(F.concat(F.lit("@"), F.round(r["score"]).cast("int").cast("string")), F.lit("")))
    change = lambda r: F.concat(r["type"], F.lit(":"), r["approval_text"], F.lit(">"), r["sample_text"])
    some = lambda rows, form: F.concat(F.lit(" ["), F.coalesce(F.array_join(F.transform(rows, form), ";"), F.lit("")), F.lit("]"))
    told = F.transform("samples", lambda s: F.concat(number(s["sample_no"]), F.lit(" "), s["status"], F.lit(" "), F.round(s["score"] * 10).cast("int").cast("string"), some(s["fields"], field), some(s["lines"], lambda r: F.concat(r["line"].cast("string"), r["status"])), some(s["differences"], change)))
    passed = F.size(F.filter("samples", lambda s: s["status"] == "PASS"))
    return records.select("group_id", "page", F.col("text").alias("approval_text"), F.col("samples_count").cast("long"), passed.cast("long").alias("passed"), F.array_join(told, "\n").alias("samples"))


assert set(ORACLE_SQL) <= set(QUERIES)
