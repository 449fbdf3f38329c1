"""Brand-colour candidates: features per palette colour, a classifier, and the best colour of each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chromaspan.functions import color

FEATURES = ("share", "rank", "sat", "lum", "on_white", "on_black", "is_token_n", "bg_share", "score_mean", "l", "a", "b")
VERSION = 1


def candidates(stats: DataFrame) -> DataFrame:
    """The colour statistics (site, hex, n, bg, score, is_token) with FEATURES."""
    site = Window.partitionBy("site")
    lab = color.lab(F.col("hex"))
    lum = color.luminance(F.col("hex"))
    rank = (F.row_number().over(site.orderBy(F.desc("n"), "hex")) - 1) / F.greatest(F.lit(1), F.count("*").over(site) - 1)
    return stats.select("site", "hex", "n", (F.col("n") / F.sum("n").over(site)).alias("share"), rank.alias("rank"), color.saturation(F.col("hex")).alias("sat"), lum.alias("lum"), color.contrast(lum, F.lit(1.0)).alias("on_white"), color.contrast(lum, F.lit(0.0)).alias("on_black"), F.col("is_token").cast("double").alias("is_token_n"), (F.col("bg") / F.col("n")).alias("bg_share"), (F.col("score") / F.col("n")).alias("score_mean"), lab["l"].alias("l"), lab["a"].alias("a"), lab["b"].alias("b"))


def fit(rows: DataFrame, label: str = "label"):
    """A pipeline (assembler, logistic classifier) over FEATURES; rows need them and a 0/1 label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), LogisticRegression(labelCol=label, regParam=0.01, maxIter=30)]).fit(rows)


def best(scored: DataFrame) -> DataFrame:
    """site, hex, p: the most likely colour of each site, ties by hex."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    return scored.withColumn("p", p).groupBy("site").agg(F.max_by("hex", F.struct("p", "hex")).alias("hex"), F.max("p").alias("p"))


def leave_one_site_out(rows: DataFrame, label: str = "label") -> float:
    """Share of sites whose best colour, by a model fitted on the other sites, has the label."""
    right = n = 0
    for (site,) in sorted(rows.select("site").distinct().collect()):
        top = best(fit(rows.where(F.col("site") != site), label).transform(rows.where(F.col("site") == site)))
        right += top.join(rows, ["site", "hex"]).where(F.col(label) == 1).count()
        n += 1
    return right / max(1, n)


def scored(model, rows: DataFrame, least: float = 0.5) -> DataFrame:
    """site, hex, p, rank, is_brand: each site's candidates, likeliest first (ties by hex); brand colours have at least ``least``."""
    from pyspark.ml.functions import vector_to_array

    p = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return p.select("site", "hex", "p", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("p"), "hex")).cast("long").alias("rank"), (F.col("p") >= least).alias("is_brand"))


def save_model(model, spark: SparkSession, path: str) -> None:
    """The model, and beside it the version and names of the features that it was fitted on."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(VERSION, list(FEATURES))], "version int, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """A saved model; ValueError if it was fitted on features of another version, or on others."""
    from pyspark.ml import PipelineModel

    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["version"] != VERSION or tuple(meta["features"]) != FEATURES:
        raise ValueError(f"model at {path} is for features {meta and meta['version']}, not {VERSION}: fit it again")
    return PipelineModel.load(f"{path}/model")
