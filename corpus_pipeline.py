"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs. The filtering
stages return the columns of documents. Decisions are taken and carried out by row: where ids are missing or repeated,
rows get keys of their own in the order of the ids (null ids last, so a row with an id stays before one without).

Defined cases: null text counts as empty; an empty text is scored like one without evidence, all empty texts are one
group of exact copies, have no near copies and hold no benchmark item; of repeated rows, and of several texts under one id, each
row is decided by its own text, so one of equal rows stays; ties go to the smaller id, then to the first row; columns
beside doc_id and text are kept as they are (their names must not begin with two underscores); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagsmith.llm.common import staged, table, with_row_keys
from tagsmith.llm.decontamination import contaminated
from tagsmith.llm.exact_dedup import exact_dedup
from tagsmith.llm.jaccard_join import jaccard_join
from tagsmith.llm.packing import pack
from tagsmith.llm.toxicity import model_for, with_score

#: Documents of this score or more go.
TOXIC = 0.7


ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    return with_row_keys(docs, "doc_id", ROW)[0]


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows of these keys, in the columns of documents."""
    return docs.join(rows.select(ROW).distinct(), ROW, "left_anti").drop(ROW)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC."""
    model = model_for(docs, table(spark, sf_dir, "labels"))
    return with_score(docs, model, score_col="__score").where(f"__score < {TOXIC}").drop("__score")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    docs = _keyed(docs)
    return _without(docs, exact_dedup(docs, id_col=ROW).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest doc_id."""
    docs = _keyed(docs)
    return _without(docs, jaccard_join(docs, id_col=ROW, k=5, num=4, den=5).where(f"{ROW} <> component_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    docs = _keyed(docs)
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark"), id_col=ROW))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in windows of 4096 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", dedup), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: Compression lengths, shingle components and token ids are out of SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
