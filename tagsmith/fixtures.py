"""Label tables made from the given star schema: label pairs, OCR words, pixels, barcode candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Spark and DuckDB read this text alike. v: 0 none, 1 QTY + 1, 2 no BUYER, 3 extra CARTON NO, 4 buyer in lower case, 5 longer DESCRIPTION, 6 no SIZE.
_PAIR_TEXTS = """o_orderkey AS pair_id, v,
  concat('BUYER: ', c_name, chr(10), 'BUYER CODE: C-', cast(c_custkey AS varchar(20)), chr(10),
    'PO NO: ', cast(o_orderkey AS varchar(20)), chr(10), 'STYLE NO: ', p_brand, '-', cast(p_partkey AS varchar(20)), chr(10),
    'DESCRIPTION: ', p_name, chr(10), p_type, chr(10), '*', chr(10), 'SIZE: ', cast(p_size AS varchar(20)), chr(10),
    'QTY: ', cast(qty AS varchar(20)), ' PCS', chr(10), 'COUNTRY OF ORIGIN: ', n_name) AS atext,
  concat(CASE WHEN v = 2 THEN '' ELSE concat('BUYER: ', CASE WHEN v = 4 THEN lower(c_name) ELSE c_name END, chr(10)) END,
    'BUYER CODE: C-', cast(c_custkey AS varchar(20)), chr(10), 'PO NO: ', cast(o_orderkey AS varchar(20)), chr(10),
    'STYLE NO: ', p_brand, '-', cast(p_partkey AS varchar(20)), chr(10),
    'DESCRIPTION: ', CASE WHEN v = 5 THEN concat(p_name, ' XL') ELSE p_name END, chr(10), p_type, chr(10), '*', chr(10),
    CASE WHEN v = 6 THEN '' ELSE concat('SIZE: ', cast(p_size AS varchar(20)), chr(10)) END,
    'QTY: ', cast(qty + CASE WHEN v = 1 THEN 1 ELSE 0 END AS varchar(20)), ' PCS', chr(10), 'COUNTRY OF ORIGIN: ', n_name,
    CASE WHEN v = 3 THEN concat(chr(10), 'CARTON NO: ', cast(lines AS varchar(20))) ELSE '' END) AS stext"""
_PAIR_ROWS = """(SELECT l_orderkey, cast(l_orderkey % 7 AS int) AS v, min(l_partkey) AS partkey, cast(sum(l_quantity) AS int) AS qty, count(*) AS lines
      FROM lineitem GROUP BY l_orderkey) l
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN part ON partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey
"""
LABEL_PAIRS_SQL = f"\nSELECT {_PAIR_TEXTS}\nFROM {_PAIR_ROWS}"


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores, as label files would be: the joins that make them move few bytes, and Spark would merge their partitions to a few."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, v, atext, stext."""
    load(spark, sf_dir, "lineitem", "orders", "customer", "part", "nation")
    # the texts are made after the deal: what moves is a few short values a pair
    rows = _dealt(spark.sql(f"SELECT o_orderkey, v, c_name, c_custkey, p_brand, p_partkey, p_name, p_type, p_size, qty, n_name, lines FROM {_PAIR_ROWS}"))
    return spark.sql(f"SELECT {_PAIR_TEXTS} FROM {{rows}}", rows=rows)


#: OCR words of label texts: one row per token with a box on a grid; SQL of both engines.
LABEL_WORDS_SQL = """
SELECT doc_id AS label_id, cast(doc_id % 3 AS int) AS variant_ord, i AS seq, word AS text,
  cast((i * 37 + doc_id) % 101 AS double) AS confidence, cast((i % 7) * 60 AS int) AS x,
  cast((i div 7) * 40 + i % 3 AS int) AS y, cast(10 * length(word) AS int) AS w, 20 AS h,
  cast(i div 21 AS int) AS block_num, 0 AS par_num, cast((i div 7) % 3 AS int) AS line_num
FROM (SELECT doc_id, posexplode(filter(split(text, '[ \\n\\t]+'), x -> x <> '')) AS (i, word) FROM documents)
"""
LABEL_WORDS_DUCK = LABEL_WORDS_SQL.replace(" div ", " // ").replace(
    "(SELECT doc_id, posexplode(filter(split(text, '[ \\n\\t]+'), x -> x <> '')) AS (i, word) FROM documents)",
    "(SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') AS ws FROM documents))",
)


def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(LABEL_WORDS_SQL.replace("\\", "\\\\"))


#: Images from vectors: 8 x 8 pixels, value scaled to 0..255, an edge where a neighbour differs much.
LABEL_PIXELS_SQL = """
SELECT vec_id AS image_id, cast(p div 8 AS int) AS y, cast(p % 8 AS int) AS x, v,
  CASE WHEN abs(v - coalesce(lag(v) OVER (PARTITION BY vec_id ORDER BY p), v)) >= 40 THEN 1 ELSE 0 END AS edge
FROM (SELECT vec_id, p, CASE WHEN vec_id % 17 = 0 THEN 128 ELSE cast(greatest(0, least(255, floor(128 + 400 * cast(e AS double)))) AS int) END AS v
      FROM (SELECT vec_id, posexplode(slice(embedding, 1, 64)) AS (p, e) FROM embeddings))
"""
LABEL_PIXELS_DUCK = LABEL_PIXELS_SQL.replace(" div ", " // ").replace(
    "(SELECT vec_id, posexplode(slice(embedding, 1, 64)) AS (p, e) FROM embeddings)",
    "(SELECT vec_id, unnest(embedding[1:64]) AS e, unnest(range(least(64, len(embedding)))) AS p FROM embeddings)",
)


def label_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "embeddings")
    return spark.sql(LABEL_PIXELS_SQL)


#: Seven candidate detections per label and side, cases of every branch of the comparison.
BARCODES_SQL = """
SELECT o_orderkey AS label_id, side, v AS variant_ord,
  CASE WHEN (o_orderkey + side * 3) % 7 = 0 THEN 'ERROR' WHEN (o_orderkey + side) % 11 = 0 THEN 'NOT_CHECKED' ELSE 'OK' END AS state,
  (o_orderkey * 7 + v * 3 + side * 5) % 4 <> 0 AND (o_orderkey + side) % 5 <> 0 AS detected,
  CASE WHEN (o_orderkey + v * 5 + side * (o_orderkey % 3)) % 6 = 0 AND (o_orderkey * 7 + v * 3 + side * 5) % 4 <> 0 AND (o_orderkey + side) % 5 <> 0
    THEN concat(CASE WHEN v % 2 = 0 THEN ' ctn ' ELSE 'CTN' END, cast(o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN side ELSE 0 END AS varchar(20))) ELSE '' END AS decoded
FROM orders CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 AS side) s
CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) vs
"""


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "orders")
    return spark.sql(BARCODES_SQL)




#: Raw tokens of nine OCR calls a label (four variants by two page modes of the first engine, one call of the second), each
#: with a quarter of the words; c is the call's number. The same text in both engines but for the list of calls.
_TOKEN_COLUMNS = """SELECT label_id, CASE WHEN c < 8 THEN 'tesseract' ELSE 'easyocr' END AS engine, cast(CASE WHEN c < 8 THEN (c - c % 2) / 2 ELSE 0 END AS int) AS variant_ord,
  cast(CASE WHEN c < 8 THEN c % 2 ELSE 0 END AS int) AS psm_ord, seq, CASE WHEN (seq + c) % 13 = 2 THEN '  ' ELSE text END AS text,
  CASE WHEN c = 8 THEN cast(cast((seq * 29 + label_id) % 101 AS double) / 100 AS varchar(30)) WHEN (seq + c) % 11 = 4 THEN '-1' ELSE cast((seq * 37 + label_id + c * 13) % 101 AS varchar(30)) END AS confidence,
  cast(x AS varchar(20)) AS x, cast(y AS varchar(20)) AS y, cast(w AS varchar(20)) AS w, cast(h AS varchar(20)) AS h, block_num, par_num, line_num FROM """
_KEPT = "(seq + label_id + c * 2) % 4 = 0"
OCR_TOKENS_DUCK = _TOKEN_COLUMNS + f"(SELECT *, unnest(list_filter(range(9), lambda c: {_KEPT})) AS c FROM ({LABEL_WORDS_DUCK}))"


def ocr_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(_TOKEN_COLUMNS + f"(SELECT *, explode(filter(sequence(0, 8), c -> {_KEPT})) AS c FROM ({LABEL_WORDS_SQL}))".replace("\\", "\\\\"))


#: Each label's nine calls: the first engine is away for every tenth label, and single calls time out.
_CALL_COLUMNS = """SELECT label_id, CASE WHEN c < 8 THEN 'tesseract' ELSE 'easyocr' END AS engine, cast(CASE WHEN c < 8 THEN (c - c % 2) / 2 ELSE 0 END AS int) AS variant_ord,
  cast(CASE WHEN c < 8 THEN c % 2 ELSE 0 END AS int) AS psm_ord, NOT (c < 8 AND label_id % 10 = 3) AND (label_id + c) % 7 <> 0 AS available,
  CASE WHEN c < 8 AND label_id % 10 = 3 THEN 'engine is not installed' WHEN (label_id + c) % 7 = 0 THEN concat('call ', cast(c AS varchar(9)), ' timed out') END AS error FROM """
OCR_CALLS_DUCK = _CALL_COLUMNS + "(SELECT doc_id AS label_id, unnest(range(9)) AS c FROM documents)"


def ocr_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(_CALL_COLUMNS + "(SELECT doc_id AS label_id, explode(sequence(0, 8)) AS c FROM documents)")


#: Sizes of the image that was read and of the source image.
OCR_IMAGES_SQL = "SELECT doc_id AS label_id, cast(400 + doc_id % 3 * 100 AS int) AS ocr_w, 400000 AS ocr_h, 600 AS image_w, 300000 AS image_h FROM documents"


def ocr_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    load(spark, sf_dir, "documents")
    return spark.sql(OCR_IMAGES_SQL)


#: Approval labels of customers; their orders are the samples, none to many. v: 0 none, 1 other code, 2 no origin, 3 one line more, 4 buyer in lower case, 5 two lines changed, 6 lines swapped.
APPROVALS_SQL = """SELECT c_custkey AS group_id, concat('BUYER: ', c_name, chr(10), 'BUYER CODE: C-', cast(c_custkey AS varchar(20)), chr(10), 'VENDOR: ', c_mktsegment, ' TRADING', chr(10),
  'SHIPMENT MODE: SEA', chr(10), 'CARE: WASH COLD', chr(10), 'COUNTRY OF ORIGIN: ', n_name) AS text FROM customer JOIN nation ON c_nationkey = n_nationkey"""
SAMPLES_SQL = """SELECT o_custkey AS group_id, o_orderkey AS sample_no, concat('BUYER: ', CASE WHEN v = 4 THEN lower(c_name) ELSE c_name END, chr(10),
  CASE WHEN v = 6 THEN concat('VENDOR: ', c_mktsegment, ' TRADING', chr(10)) ELSE '' END,
  'BUYER CODE: C-', cast(c_custkey + CASE WHEN v = 1 THEN 1 ELSE 0 END AS varchar(20)), chr(10),
  CASE WHEN v = 6 THEN '' ELSE concat('VENDOR: ', c_mktsegment, CASE WHEN v = 5 THEN ' TRADERS' ELSE ' TRADING' END, chr(10)) END,
  'SHIPMENT MODE: ', CASE WHEN v = 5 THEN 'AIR' ELSE 'SEA' END, chr(10), CASE WHEN v = 3 THEN concat('CARTON NO: ', cast(o_orderkey AS varchar(20)), chr(10)) ELSE '' END,
  'CARE: WASH COLD', CASE WHEN v = 2 THEN '' ELSE concat(chr(10), 'COUNTRY OF ORIGIN: ', n_name) END) AS text
FROM (SELECT *, o_orderkey % 7 AS v FROM orders) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, text: one label a customer."""
    load(spark, sf_dir, "customer", "nation")
    return _dealt(spark.sql(APPROVALS_SQL))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, sample_no, text: one label an order."""
    load(spark, sf_dir, "orders", "customer", "nation")
    return _dealt(spark.sql(SAMPLES_SQL))


#: Uploaded files of requests (one an order): names with and without allowed endings, empty entries, none or several approvals, sums over the limit.
UPLOADS_SQL = """SELECT l_orderkey AS request_id, CASE WHEN l_linenumber = 1 THEN 'approval' ELSE 'sample' END AS role,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS int) AS position,
  CASE WHEN l_partkey % 41 = 7 THEN '' ELSE concat('label_', cast(l_partkey AS varchar(20)), '.', CASE (l_suppkey + l_partkey) % 23 WHEN 0 THEN 'gif' WHEN 1 THEN 'PNG' WHEN 2 THEN 'pdf' WHEN 3 THEN 'Webp' ELSE 'jpg' END) END AS name,
  cast(l_quantity * 400000 AS bigint) AS length FROM lineitem"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, role, position, name, length."""
    load(spark, sf_dir, "lineitem")
    return spark.sql(UPLOADS_SQL)


#: Posted results of orders: whole ones, some with unknown members or without some values; broken, empty and mistyped ones.
PAYLOADS_SQL = """SELECT payload_id, CASE WHEN payload_id % 19 = 2 THEN NULL WHEN payload_id % 23 = 2 THEN '  ' WHEN payload_id % 29 = 3 THEN '[1, 2]' WHEN payload_id % 11 = 4 THEN substr(body, 1, length(body) - 5) ELSE body END AS body
FROM (SELECT o_orderkey AS payload_id, concat('{"approval":{"filename":"a', cast(o_custkey AS varchar(20)), '.png","ocr_text":"', o_orderpriority, '"},', CASE WHEN o_orderkey % 5 = 0 THEN '"client":{"v":1},' ELSE '' END, '"samples":[',
  CASE WHEN o_orderkey % 17 = 8 THEN '' ELSE concat('{"filename":"s', cast(o_orderkey AS varchar(20)), '.png","score":', CASE WHEN o_orderkey % 13 = 6 THEN '"high"' ELSE concat(cast(o_orderkey % 100 AS varchar(20)), '.5') END,
    ',"status":"', CASE WHEN o_orderkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END, '"', CASE WHEN o_orderkey % 7 = 1 THEN '' ELSE ',"matched":3,"mismatched":1,"missing":0,"extra":2' END,
    ',"fields":[{"field":"SIZE","approval":"4","sample":"', cast(o_orderkey % 9 AS varchar(20)), '","status":"MATCH","score":100.0},{"field":"QTY","approval":"","sample":"1","status":"EXTRA","score":0.0}]},{"filename":"t.png","status":"PASS","fields":[]}') END, ']}') AS body FROM orders)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_id, body."""
    load(spark, sf_dir, "orders")
    return spark.sql(PAYLOADS_SQL)
