"""Fault isolation: a category that cannot be read is recorded and left empty; the rest of its capture stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stage of a document that is no JSON at all.
WHOLE = "document"


def isolated(captures: DataFrame, stages: dict[str, str], json: str = "json") -> DataFrame:
    """The captures with a column for each stage (name: the type of that member, an array) and errors (array of stage and reason).

    A member that is absent or null is empty and no error. One of another type, or with an element of another type, is empty and an
    error of its own stage (a wrong member of an element is null in it); a document that cannot be parsed is empty in all stages and one error. A null document is like an empty one.
    """
    rows = captures.withColumn("_doc", F.try_parse_json(F.coalesce(json, F.lit("{}"))))
    read = lambda name, kind: F.try_variant_get("_doc", f"$.{name}", kind)
    there = lambda name: read(name, "variant").isNotNull() & ~F.is_variant_null(F.coalesce(read(name, "variant"), F.parse_json(F.lit("null"))))
    # a cast makes an element of another type null, so there must be no more nulls after it than before
    nulls = lambda values, test: F.size(F.filter(values, test))
    whole = lambda name, kind: nulls(read(name, kind), F.isnull) <= nulls(read(name, "array<variant>"), lambda v: F.isnull(v) | F.is_variant_null(v))
    rows = rows.withColumns({f"_{name}": F.when(whole(name, kind), read(name, kind)) for name, kind in stages.items()})
    error = lambda stage, reason: F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))
    failed = [F.when(F.col("_doc").isNull(), error(WHOLE, F.lit("not JSON")))]
    failed += [F.when(there(name) & F.col(f"_{name}").isNull(), error(name, F.concat(F.lit(f"not {kind}: "), F.schema_of_variant(read(name, "variant"))))) for name, kind in stages.items()]
    return rows.select(*captures.columns, *(F.coalesce(f"_{name}", F.array().cast(kind)).alias(name) for name, kind in stages.items()), F.array_compact(F.array(*failed)).alias("errors"))


def errors(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, stage, reason: what ``isolated`` could not read, a row each."""
    return rows.select(*keys, F.explode("errors").alias("e")).select(*keys, "e.stage", "e.reason")
