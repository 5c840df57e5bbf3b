"""Labels that OCR misread by look-alike characters: a canonical key by classes of confusion, and a join on it.

Off by default: a value such as an order number may hold O and 0 side by side, so only the labels before values are read so,
and only where a line starts with no label as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsmith.functions.aliases import owners
from tagsmith.functions.text import clean_value, label_form

#: Letters that are taken for digits.
CONFUSED = {"O": "0", "I": "1", "L": "1", "S": "5", "B": "8", "Z": "2"}


def canonical(label: Column) -> Column:
    """The key of a label: look-alikes are one character, breaks do not count."""
    return F.regexp_replace(F.translate(label_form(label), "".join(CONFUSED), "".join(CONFUSED.values())), "[^A-Z0-9]", "")


def alias_keys(spark: SparkSession) -> DataFrame:
    """key, alias, field of every label; a table as small as the dictionary."""
    rows = spark.createDataFrame(list(owners().items()), "alias string, field string")
    return rows.select(canonical(F.col("alias")).alias("key"), "alias", "field")


def confusable_starts(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, said, alias, field, distance, remainder of the lines (column line) whose text before the first : = | or ; reads as a label by its key.

    Of several labels with one key the nearest by edit distance to what was said is taken, the first by name of equals. Distances
    are asked for inside a key alone.
    """
    parts = F.split("line", r"\s*[:=|;]", 2)
    rows = lines.select(*keys, "line", parts[0].alias("said"), clean_value(F.get(parts, F.lit(1))).alias("remainder")).where("said <> '' and size(split(line, '[:=|;]', 2)) = 2")
    rows = rows.withColumn("key", canonical(F.col("said"))).where("key <> ''")
    met = rows.join(F.broadcast(alias_keys(lines.sparkSession)), "key").withColumn("distance", F.levenshtein(F.upper("said"), "alias"))
    best = F.min(F.struct("distance", "alias", "field")).alias("b")
    return met.groupBy(*keys, "said", "remainder").agg(best).select(*keys, "said", "b.alias", "b.field", "b.distance", "remainder")
