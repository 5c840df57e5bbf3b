"""Result sinks: one JSON document per pair, report tables as Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results_json(summary: DataFrame, rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, json: the summary with its compared fields nested."""
    nested = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("field_ord", "field", "approval", "sample", "status", "score"))), lambda r: r.dropFields("field_ord")).alias("fields"))
    wide = summary.join(nested, key, "left")
    return wide.select(key, F.to_json(F.struct(*[c for c in wide.columns])).alias("json"))


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{path}/{name}")
