"""Models of brand colours: scores, and the version of their features."""

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import brand


def test_scores_and_versions(spark, tmp_path):
    stats = [(s, h, n, bg, score, tok) for s in range(4) for h, n, bg, score, tok in (("#0066cc", 40 + s, 30, 400, True), ("#ffffff", 90, 80, 90, False), ("#808080", 30, 2, 30, False), ("#111111", 20 - s, 1, 20, False))]
    rows = brand.candidates(spark.createDataFrame(stats, "site long, hex string, n long, bg long, score long, is_token boolean")).withColumn("label", (F.col("hex") == "#0066cc").cast("double"))
    path = str(tmp_path)
    brand.save_model(brand.fit(rows), spark, path)
    out = brand.scored(brand.load_model(spark, path), rows)
    assert {(r["site"], r["hex"]) for r in out.where("rank = 1 and is_brand").collect()} == {(s, "#0066cc") for s in range(4)}
    assert out.where("is_brand").count() == 4 and out.where("p < 0 or p > 1").count() == 0 and out.where("rank = 4").count() == 4
    spark.createDataFrame([(brand.VERSION + 1, list(brand.FEATURES))], "version int, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="fit it again"):
        brand.load_model(spark, path)
    spark.createDataFrame([(brand.VERSION, ["x"])], "version int, features array<string>").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="fit it again"):
        brand.load_model(spark, path)
