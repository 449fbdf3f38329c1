"""A corpus pipeline: toxic and poor documents go, near-duplicates are reduced to one, personal data is replaced,
what is left is packed into training sequences.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before has kept; all but the last
return the columns of documents. run() writes each stage's rows to the shared folder and reads them again, so
a stage is not repeated when an executor is lost. Models are fitted on the labels of sf_dir that belong to
documents of the stage's own input.

Defined cases: a null text is judged as the empty one and stays null; texts of any length are read whole; rows
without a doc_id stay until packing, which gives their pieces a null doc_id; rows that share a doc_id are judged one
by one, and the near-duplicate stage keeps one of them; an empty table gives an empty one; other columns, whatever
their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.llm import common, neardup, packing, pii, quality, queries, toxicity

#: The pipeline has no SQL form: three stages are fitted models or packing. Tested stage by stage instead.
ORACLE_SQL = None
TOXIC_LIMIT, QUALITY_LIMIT = 0.5, 0.3


def _plain(docs: DataFrame) -> DataFrame:
    """The rows under neutral column names, beside doc_id and a text without nulls, so that no name can clash."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), F.coalesce("text", F.lit("")).alias("text"))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return _named(toxicity.apply(_plain(docs), model).where(F.col(f"p_{model.names[-1]}") < TOXIC_LIMIT), docs)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the quality limit go."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _named(quality.apply(_plain(docs), model).where(F.col("score") >= QUALITY_LIMIT), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id (of rows that share it, the one with
    the smallest text, null first).

    Groups: five-word shingles, similarity 0.8 or more. Rows without a doc_id stay.
    """
    groups = neardup.near_duplicates(docs, width=5, percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("said"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = rows.where("id is not null")
    if _repeats(groups):
        once = once.groupBy("id").agg(F.min_by("row", F.struct("said", F.xxhash64("row"))).alias("row"))
    kept = once.join(gone, "id", "left_anti").select("row").union(rows.where("id is null").select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _repeats(groups: DataFrame) -> bool:
    return not groups.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; n_chars, where there is one, follows."""
    found = pii.with_spans(_plain(docs))
    new = pii.redacted(F.col("text"), F.col("pii_spans"))
    changed = F.size("pii_spans") > 0
    out = []
    for k, c in enumerate(docs.columns):
        own = F.col(f"c{k}")
        if c == "text":
            own = F.when(changed, new).otherwise(own)
        elif c == "n_chars":
            own = F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in as few sequences as possible."""
    return packing.best_fit_packing(docs, queries.tokenizer_path("word_bpe_49k.json"), 2048)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-duplicates", drop_near_copies), ("personal data", hide_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs)
    return docs
