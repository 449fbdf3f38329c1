"""Colours from beside the page's own scan, put into its palette in the order of their sources.

A palette's row is made by the first source that has the colour: the scan, the manifest, logos, gradients, states of
elements, then the dark, mobile and opened-menu variants of the page. Manifest and logo also lift a row that is there
already. As a later source only sees whether a row exists, the upserts of all sources are one group-by of (site, hex).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import color

SCAN, MANIFEST, LOGO, GRADIENT, STATE, DARK, MOBILE, MENU = range(8)
VARIANTS = {DARK: "dark-mode", MOBILE: "mobile", MENU: "menu"}
COLUMNS = "rank int, site long, ord long, value string, hex string, n long, confidence string, sources array<string>"


def _entries(rows: DataFrame, rank: int, n, confidence, sources: Column, keep: Column | None = None) -> DataFrame:
    """rows: site, ord, value, a colour in any notation; ``keep`` is over their hex and rgba.a."""
    seen = F.col("rgba")
    own = color.parsed(rows, "value").withColumn("hex", F.when(seen.isNotNull(), color.to_hex(seen["r"], seen["g"], seen["b"])))
    if keep is not None:
        own = own.where(keep)
    legacy = F.when(seen["a"] < 1, F.format_string("rgba(%d, %d, %d, %s)", seen["r"], seen["g"], seen["b"], seen["a"].cast("string"))).otherwise(F.format_string("rgb(%d, %d, %d)", seen["r"], seen["g"], seen["b"]))
    said = F.when(F.col("value").rlike(r"(?i)^(#|rgba?\()") | seen.isNull() | F.lit(rank == MANIFEST), F.col("value")).otherwise(legacy)
    return own.select(F.lit(rank).alias("rank"), "site", F.col("ord").cast("long").alias("ord"), said.alias("value"), F.coalesce("hex", F.lower("value")).alias("hex"), n.cast("long").alias("n"), confidence.alias("confidence"), sources.alias("sources"))


def from_manifest(rows: DataFrame) -> DataFrame:
    """rows: site, ord, label (theme_color or background_color), value."""
    return _entries(rows, MANIFEST, F.lit(10), F.lit("high"), F.array(F.concat(F.lit("manifest:"), F.col("label"))))


def from_logos(rows: DataFrame) -> DataFrame:
    """rows: site, ord, value."""
    return _entries(rows, LOGO, F.lit(10), F.lit("high"), F.array(F.lit("logo")))


def from_gradients(rows: DataFrame) -> DataFrame:
    """rows: site, ord, value, n (uses of the gradient): stops of gradients used twice, mostly opaque and chromatic ones."""
    keep = (F.col("n") >= 2) & (F.col("rgba.a") >= 0.3) & (color.chroma(F.col("hex")) >= 0.2)
    return _entries(rows, GRADIENT, F.lit(2), F.lit("low"), F.array(F.lit("gradient")), keep)


def from_states(rows: DataFrame) -> DataFrame:
    """rows: site, ord, value, property: colours of hovered and focused elements; of other properties than the background dull ones."""
    keep = (F.col("rgba.a") >= 0.05) & ((F.col("property") == "background-color") | (color.saturation(F.col("hex")) <= 0.3))
    return _entries(rows, STATE, F.lit(1), F.lit("medium"), F.array(F.lit("hover/focus")), keep)


def from_scan(palette: DataFrame, rank: int = SCAN) -> DataFrame:
    """palette: site, ord, hex, n, confidence, sources; of the page itself or (rank) of a variant. What a menu shows is at most medium sure."""
    confidence = F.lit("medium") if rank == MENU else F.col("confidence")
    return palette.select(F.lit(rank).alias("rank"), "site", F.col("ord").cast("long").alias("ord"), F.col("hex").alias("value"), "hex", F.col("n").cast("long").alias("n"), confidence.alias("confidence"), "sources")


def injected(*entries: DataFrame) -> DataFrame:
    """site, ord (from 1), value, hex, n, confidence, sources, variant: the palette of all sources together."""
    rows = entries[0]
    for more in entries[1:]:
        rows = rows.union(more)
    first = F.min_by(F.struct("rank", "ord", "value", "n", "confidence", "sources"), F.struct("rank", "ord")).alias("made")
    labels = F.sort_array(F.collect_set(F.when(F.col("rank") == MANIFEST, F.struct("ord", F.get("sources", 0).alias("label"))))).alias("labels")
    out = rows.groupBy("site", "hex").agg(first, labels, F.bool_or(F.col("rank").isin(MANIFEST, LOGO)).alias("lifted"), F.bool_or(F.col("rank") == LOGO).alias("logo"))
    made = F.col("made")
    sources = F.array_distinct(F.concat(made["sources"], F.transform("labels", lambda x: x["label"])))
    sources = F.when(F.col("logo") & ~F.array_contains(sources, "logo"), F.concat(F.array(F.lit("logo")), sources)).otherwise(sources)
    variant = F.coalesce(*(F.when(made["rank"] == k, v) for k, v in VARIANTS.items()))
    place = F.row_number().over(Window.partitionBy("site").orderBy(made["rank"], made["ord"], "hex"))
    return out.select("site", place.cast("long").alias("ord"), made["value"].alias("value"), "hex", made["n"].alias("n"), F.when(F.col("lifted"), "high").otherwise(made["confidence"]).alias("confidence"), sources.alias("sources"), variant.alias("variant"))
