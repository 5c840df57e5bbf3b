"""Queries of the OCR plan: from the raw tokens of all calls to a label's words and text."""

from __future__ import annotations

from tagsmith import fixtures as X
from tagsmith.operators import ocr_plan as plan
from tagsmith.queries import _squeeze, query

SETTINGS = plan.OcrSettings(psm=11, second=True)


def _even1(x: str) -> str:
    """One decimal place, ties to even, of the number as it is written in decimals; both halves of it are exact."""
    v = f"CAST(CAST({x} AS varchar) AS decimal(30, 18))"
    return f"CAST(CASE WHEN {v} * 10 - floor({v} * 10) = 0.5 THEN 2 * round({v} * 5) / 10 ELSE round({v}, 1) END AS double)"


_PLAN = f"""tok AS ({X.OCR_TOKENS_DUCK}), calls AS ({X.OCR_CALLS_DUCK}), images AS ({X.OCR_IMAGES_SQL}),
clean AS (SELECT * REPLACE ({_squeeze('text')} AS text, round(greatest(coalesce(try_cast(confidence AS double) * CASE WHEN engine = 'easyocr' THEN 100 ELSE 1 END, 0.0), 0.0), 2) AS confidence,
    CAST(x AS int) AS x, CAST(y AS int) AS y, CAST(w AS int) AS w, CAST(h AS int) AS h) FROM tok),
used AS MATERIALIZED (SELECT * FROM clean WHERE text <> '' AND (engine = 'tesseract' OR confidence >= 25)),
scored AS (SELECT label_id, engine, variant_ord, psm_ord, conf, conf + least(letters / 20.0, 10.0) + least(n / 10.0, 5.0) AS score FROM (
    SELECT label_id, engine, variant_ord, psm_ord, count(*) AS n, sum(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) AS letters,
      coalesce(CAST(round(CAST(CASE WHEN engine = 'easyocr' THEN avg(confidence) ELSE avg(confidence) FILTER (confidence > 0) END AS decimal(20, 10)), 2) AS double), 0.0) AS conf FROM used GROUP BY label_id, engine, variant_ord, psm_ord)
  JOIN calls USING (label_id, engine, variant_ord, psm_ord) WHERE available),
won AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY label_id, engine ORDER BY score DESC, variant_ord, psm_ord) = 1),
chosen AS MATERIALIZED (SELECT i.*, CASE WHEN t.label_id IS NOT NULL THEN 'tesseract' ELSE 'easyocr' END AS engine, coalesce(t.variant_ord, e.variant_ord) AS variant_ord, coalesce(t.psm_ord, e.psm_ord) AS psm_ord,
    {_even1("""CASE WHEN t.conf > 0 AND e.conf > 0 THEN (t.conf + e.conf) / 2 WHEN t.conf > 0 THEN t.conf WHEN e.conf > 0 THEN e.conf ELSE 0.0 END""")} AS confidence
  FROM images i LEFT JOIN (SELECT * FROM won WHERE engine = 'tesseract') t USING (label_id) LEFT JOIN (SELECT * FROM won WHERE engine = 'easyocr') e USING (label_id)),
mapped AS (SELECT label_id, engine, seq, text, u.confidence, y AS raw_y, block_num, par_num, line_num, image_w, image_h,
    greatest(0, least(CAST(round_even(x * (image_w / ocr_w), 0) AS int), image_w - 1)) AS ox, greatest(0, least(CAST(round_even(y * (image_h / ocr_h), 0) AS int), image_h - 1)) AS oy,
    CAST(round_even(w * (image_w / ocr_w), 0) AS int) AS ow, CAST(round_even(h * (image_h / ocr_h), 0) AS int) AS oh
  FROM used u JOIN chosen USING (label_id, engine, variant_ord, psm_ord)),
boxed AS (SELECT * REPLACE (least(ox + ow, image_w) - ox AS ow, least(oy + oh, image_h) - oy AS oh), CASE WHEN engine = 'tesseract' THEN [block_num, par_num, line_num] ELSE [raw_y // 40] END AS line FROM mapped WHERE ow > 0 AND oh > 0),
ls AS (SELECT label_id, line, min(oy) AS min_y, min(ox) AS min_x, min(seq) AS first_seq FROM boxed GROUP BY ALL),
ln AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY min_y, min_x, first_seq) - 1 AS line_index FROM ls),
placed AS (SELECT label_id, seq, text, confidence, ox AS x, oy AS y, ow AS w, oh AS h, CAST(line_index AS int) AS line_index,
    CAST(row_number() OVER (PARTITION BY label_id, line ORDER BY ox, seq) - 1 AS int) AS word_index FROM boxed JOIN ln USING (label_id, line))"""


def _plan(spark, d):
    return plan.read_labels_by_plan(X.ocr_images(spark, d), X.ocr_calls(spark, d), X.ocr_tokens(spark, d), SETTINGS)


@query(f"""WITH {_PLAN}, lt AS (SELECT label_id, line_index, count(*) AS n, {_squeeze("string_agg(text, ' ' ORDER BY word_index)")} AS line FROM placed GROUP BY ALL),
t AS (SELECT label_id, sum(n) AS n_words, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_index) AS text FROM lt GROUP BY label_id),
f AS (SELECT label_id, CASE WHEN NOT bool_or(available) THEN arg_min(error, CASE WHEN engine = 'tesseract' THEN 0 ELSE 100 END + variant_ord * 10 + psm_ord) END AS error FROM calls GROUP BY label_id)
SELECT label_id, engine, coalesce(variant_ord, -1) AS variant_ord, coalesce(psm_ord, -1) AS psm_ord, confidence, CAST(coalesce(n_words, 0) AS bigint) AS n_words, coalesce(n_lines, 0) AS n_lines, coalesce(text, '') AS text, error FROM chosen LEFT JOIN t USING (label_id) JOIN f USING (label_id)""")
def ocr_plan(spark, d):
    return _plan(spark, d)[0].na.fill({"variant_ord": -1, "psm_ord": -1})


@query(f"WITH {_PLAN} SELECT * REPLACE (CAST(seq AS int) AS seq) FROM placed")
def ocr_plan_words(spark, d):
    return _plan(spark, d)[1]
