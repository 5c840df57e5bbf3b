"""URL filters by a temporal list join, in DataFrame operations only.

List entries are dated: (kind, value, action, effective). Entries of one (kind, value) become validity intervals,
each until the next one's date; action remove ends the one before. A capture's keys (its URL, path prefixes, host
and parent domains) meet the intervals of the same key that hold at its fetch date: an as-of join. The most specific
active entry decides: url, then the longest prefix, host, the longest domain.

A key may be that of a third of all captures: keys of at least HEAVY_SHARE of them, of which there is a bounded number, are
salted on both sides.

Defined cases: null url has no keys and no decision; entries with a null field are void; of entries of one key and date
the first of allow, block, remove holds; equal captures are evaluated once and returned as often as they came; other
columns are ignored; empty captures give an empty result, empty entries decide nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagsmith.llm.common import HEAVY_SHARE, staged, table

KINDS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}
SALTS = 32


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """Array of struct(kind, value) of the keys that a URL can be listed by."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    domains = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda n: n <= F.size(labels)), lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("value")))
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts))), lambda n: n <= F.size(parts)), lambda n: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("value")))
    own = F.array(F.struct(F.lit("url").alias("kind"), url.alias("value")), F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(url.isNotNull() & (host != ""), F.concat(own, domains, prefixes))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, value, action, since, until (null: still active) of dated entries."""
    rows = entries.where("kind is not null and value is not null and action is not null and effective is not null")
    rows = rows.groupBy("kind", "value", F.col("effective").cast("date").alias("since")).agg(F.min("action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("kind", "value").orderBy("since"))
    return rows.withColumn("until", until).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched") -> DataFrame:
    """id_col, url, fetched, decision (block, allow or none), kind, value, since of the entry that decides."""
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(date_col).cast("date").alias("fetched"))
    rows = rows.groupBy("id", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
    rows = staged(rows.withColumn("row", F.xxhash64("id", "url", "fetched")), "url-captures")
    keyed = rows.select("id", "url", "fetched", "copies", "row", F.explode_outer(url_keys(F.col("url"))).alias("k")).select("id", "url", "fetched", "copies", "row", "k.kind", "k.value")
    floor = max(16, int(rows.count() * HEAVY_SHARE))
    # at most the mean number of a capture's keys times 1 / HEAVY_SHARE keys are heavy
    heavy = F.broadcast(staged(keyed.where("kind is not null").groupBy("kind", "value").count().where(F.col("count") >= floor).select("kind", "value", F.lit(True).alias("hot")), "url-heavy"))
    keyed = keyed.join(heavy, ["kind", "value"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    listed = intervals(entries).join(heavy, ["kind", "value"], "left")
    listed = listed.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    e = listed.alias("e")
    on = (F.col("k.kind") == F.col("e.kind")) & (F.col("k.value") == F.col("e.value")) & (F.col("k.salt") == F.col("e.salt")) & (F.col("k.fetched") >= F.col("e.since")) & (F.col("e.until").isNull() | (F.col("k.fetched") < F.col("e.until")))
    met = keyed.alias("k").join(e, on, "left")
    rank = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("e.kind")]
    best = F.when(F.col("e.kind").isNotNull(), F.struct(rank.alias("rank"), F.length("e.value").alias("size"), F.col("e.value").alias("value"), F.col("e.kind").alias("kind"), F.col("e.action").alias("action"), F.col("e.since").alias("since")))
    out = met.groupBy("k.id", "k.url", "k.fetched", "k.copies").agg(F.max(best).alias("best"))
    out = out.select("id", "url", "fetched", F.coalesce("best.action", F.lit("none")).alias("decision"), "best.kind", "best.value", "best.since", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy").withColumnRenamed("id", id_col)


def lists_from_pages(pages: DataFrame) -> DataFrame:
    """The dated lists of the query: pages carry none, so their own hosts, paths and URLs are listed by fixed rules."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", F.length("host"))
    day = lambda start, plus: F.date_add(F.lit(start).cast("date"), plus)
    row = lambda df, kind, value, action, at: df.select(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("effective"))
    third, even = hosts.where("n % 3 = 0"), hosts.where("n % 2 = 0")
    domains = hosts.select(F.substring_index("host", ".", -2).alias("d")).distinct()
    urls = pages.where("page_id % 10 = 0").select("url", "page_id")
    out = row(third, "host", F.col("host"), "block", day("2024-02-01", F.col("n") % 28))
    out = out.union(row(third, "host", F.col("host"), "remove", day("2024-08-01", F.col("n") % 28)))
    out = out.union(row(even, "prefix", F.concat(F.col("host"), F.lit("/fr")), "block", day("2024-03-01", F.col("n") % 28)))
    out = out.union(row(even, "prefix", F.concat(F.col("host"), F.lit("/fr")), "remove", day("2024-09-01", F.col("n") % 28)))
    out = out.union(row(domains.where("d like '%.org'"), "domain", F.col("d"), "block", day("2024-06-01", F.lit(0))))
    return out.union(row(urls, "url", F.col("url"), "allow", day("2024-01-15", (F.col("page_id") % 200).cast("int"))))


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures, fetched on dates given by their ids, against dated lists."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    out = evaluate(pages.withColumn("fetched", fetched), lists_from_pages(pages))
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "decision", "kind", "value", F.col("since").cast("string").alias("since"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
h AS (SELECT DISTINCT host, CAST(length(host) AS INTEGER) AS n, string_split(host, '.') AS l FROM p WHERE host <> ''),
entries AS (
  SELECT 'host' AS kind, host AS value, 'block' AS action, DATE '2024-02-01' + n % 28 AS since FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'host', host, 'remove', DATE '2024-08-01' + n % 28 FROM h WHERE n % 3 = 0
  UNION ALL SELECT 'prefix', host || '/fr', 'block', DATE '2024-03-01' + n % 28 FROM h WHERE n % 2 = 0
  UNION ALL SELECT 'prefix', host || '/fr', 'remove', DATE '2024-09-01' + n % 28 FROM h WHERE n % 2 = 0
  UNION ALL SELECT DISTINCT 'domain', l[len(l) - 1] || '.' || l[len(l)], 'block', DATE '2024-06-01' FROM h WHERE l[len(l)] = 'org'
  UNION ALL SELECT 'url', url, 'allow', DATE '2024-01-15' + CAST(page_id % 200 AS INTEGER) FROM p WHERE page_id % 10 = 0),
dated AS (SELECT kind, value, since, min(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM dated),
keys AS (
  SELECT page_id, 4 AS rank, 'url' AS kind, url AS value FROM p WHERE host <> ''
  UNION ALL SELECT page_id, 2, 'host', host FROM p WHERE host <> ''
  UNION ALL SELECT page_id, 1, 'domain', array_to_string(string_split(host, '.')[len(string_split(host, '.')) - n + 1:], '.')
    FROM p, range(2, 7) t(n) WHERE host <> '' AND n <= len(string_split(host, '.'))
  UNION ALL SELECT page_id, 3, 'prefix', host || '/' || array_to_string(parts[1:n], '/') FROM p, range(1, 7) t(n) WHERE host <> '' AND n <= len(parts)),
met AS (
  SELECT p.page_id, k.kind, k.value, s.action, s.since,
    row_number() OVER (PARTITION BY p.page_id ORDER BY k.rank DESC, length(k.value) DESC, k.value DESC) AS i
  FROM p JOIN keys k USING (page_id) JOIN spans s ON s.kind = k.kind AND s.value = k.value
    AND p.fetched >= s.since AND (s.until IS NULL OR p.fetched < s.until) AND s.action <> 'remove')
SELECT p.page_id, p.url, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(m.action, 'none') AS decision, m.kind, m.value,
  CAST(m.since AS VARCHAR) AS since
FROM p LEFT JOIN met m ON m.page_id = p.page_id AND m.i = 1
"""
