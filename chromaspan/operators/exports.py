"""Token tables to token documents in the object form: a row per token, assembled to one document a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromaspan.functions import color
from chromaspan.operators.extract import top
from chromaspan.operators.nodes import assemble, quoted

#: How many tokens of a section a document lists.
COLORS, STYLES, SPACINGS, RADII, BORDERS, SHADOWS = 30, 10, 12, 6, 10, 6
ZERO = '{"value":0,"unit":"px"}'


def number(x: Column) -> Column:
    """A number's JSON, whole ones without a point."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def color_value(value: Column, alpha: Column | None = None) -> Column:
    """The JSON of a colour #rrggbb: components to three places; alpha only below 1."""
    part = lambda k: number(F.round(F.conv(F.substring(value, k, 2), 16, 10).cast("double") / 255, 3))
    clear = F.lit("") if alpha is None else F.when(alpha < 1, F.concat(F.lit(',"alpha":'), number(F.round(alpha, 3)))).otherwise("")
    return F.concat(F.lit('{"colorSpace":"srgb","components":['), part(2), F.lit(","), part(4), F.lit(","), part(6), F.lit('],"hex":"'), F.lower(value), F.lit('"'), clear, F.lit("}"))


def dimension(value: Column) -> Column:
    """The JSON of a length in px or rem (em counts as rem, a bare number as px, what stands in parentheses is left out);
    null for other units."""
    clean = F.trim(F.regexp_extract(value, r"^([^(]*)", 1))
    n, unit = F.regexp_extract(clean, r"(?i)^([-0-9.]+)\s*([a-z%]*)$", 1).try_cast("double"), F.lower(F.regexp_extract(clean, r"(?i)^([-0-9.]+)\s*([a-z%]*)$", 2))
    unit = F.when(unit == "", "px").when(unit == "em", "rem").otherwise(unit)
    return F.when(n.isNotNull() & unit.isin("px", "rem"), F.concat(F.lit('{"value":'), number(n), F.lit(',"unit":"'), unit, F.lit('"}')))


def token_name(name: Column) -> Column:
    """Lower case, without a leading $, with hyphens for braces, dots and white space."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\$", ""), r"[{}.]", "-"), r"\s+", "-"))


def _rows(rows: DataFrame, section: tuple[str, ...], name: Column, order: Column, type_: str, value: Column, about: Column | None = None) -> DataFrame:
    """site, path, ord, type, value, about; of equal names the last value at the first place."""
    about = F.lit(None).cast("string") if about is None else about
    own = rows.select("site", name.alias("name"), order.cast("long").alias("ord"), value.alias("value"), about.alias("about")).where("value is not null and name is not null")
    own = own.groupBy("site", "name").agg(F.min("ord").alias("at"), F.max_by(F.struct("value", "about"), "ord").alias("v"))
    return own.select("site", F.array(*map(F.lit, section), F.col("name")).alias("path"), F.col("at").alias("ord"), F.lit(type_).alias("type"), F.col("v.value").alias("value"), F.col("v.about").alias("about"))


def _seen(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The distinct values of a column, numbered by their first rank among the first ``most`` rows of a site."""
    first = top(rows, ["site"], [F.desc("n"), *(c for c in rows.columns if c not in ("site", "n"))], most).groupBy("site", key).agg(F.min("rank").alias("at"))
    return top(first, ["site"], ["at"], most)


def colors(palette: DataFrame) -> DataFrame:
    rows = top(palette.where("confidence <> 'low'"), ["site"], [F.desc("n"), "hex"], COLORS)
    about = F.concat(F.lit("Count: "), F.col("n").cast("string"), F.lit(", Confidence: "), F.col("confidence"))
    return _rows(rows, ("color", "palette"), F.concat(F.lit("palette-"), F.col("rank").cast("string")), F.col("rank"), "color", color_value(F.col("hex")), about)


def semantic(roles: DataFrame) -> DataFrame:
    """roles: site, role, ord, value (a colour in any notation)."""
    seen = F.col("rgba")
    rows = color.parsed(roles, "value").withColumn("hex", F.when(seen.isNotNull(), color.to_hex(seen["r"], seen["g"], seen["b"])))
    return _rows(rows, ("color", "semantic"), token_name(F.col("role")), F.col("ord"), "color", color_value(F.col("hex"), seen["a"].cast("double")))


def families(styles: DataFrame) -> DataFrame:
    """styles: site, context, family, size, weight, first (order)."""
    return _rows(styles.where("family <> ''"), ("typography", "font-family"), token_name(F.col("family")), F.col("first"), "fontFamily", quoted(F.col("family")))


def text_styles(styles: DataFrame) -> DataFrame:
    """The first ten styles of a site; line height and letter spacing (optional columns) default to 1.5 and 0."""
    rows = top(styles, ["site"], ["first", "context", "family", "size", "weight"], STYLES).where("family <> ''")
    optional = lambda c: F.col(c).cast("string") if c in styles.columns else F.lit(None).cast("string")
    leading = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(optional("line_height"), F.lit("")), r"^\s*([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.5))
    value = F.concat(
        F.lit('{"fontFamily":"{typography.font-family.'), token_name(F.col("family")), F.lit('}","fontSize":'), dimension(F.col("size").cast("string")), F.lit(',"fontWeight":'), F.coalesce(F.col("weight").cast("long"), F.lit(400)).cast("string"),
        F.lit(',"lineHeight":'), number(leading), F.lit(',"letterSpacing":'), F.coalesce(dimension(optional("letter_spacing")), F.lit(ZERO)), F.lit("}"))
    return _rows(rows, ("typography", "style"), F.concat(F.lit("text-"), token_name(F.col("context"))), F.col("rank"), "typography", value)


def spacings(spacing: DataFrame) -> DataFrame:
    rows = top(spacing, ["site"], [F.desc("n"), "px"], SPACINGS)
    return _rows(rows, ("spacing",), F.concat(F.lit("spacing-"), F.col("rank").cast("string")), F.col("rank"), "dimension", dimension(F.col("px").cast("string")))


def radii(radius: DataFrame) -> DataFrame:
    rows = top(radius.where("confidence <> 'low'"), ["site"], [F.desc("n"), "radius"], RADII)
    return _rows(rows, ("radius",), F.concat(F.lit("radius-"), F.col("rank").cast("string")), F.col("rank"), "dimension", dimension(F.col("radius").cast("string")))


def borders(combinations: DataFrame) -> DataFrame:
    """Distinct widths and colours of the ten most used combinations (site, width, style, hex, n, confidence)."""
    rows = combinations.where("confidence <> 'low'").select("site", "n", "hex", "style", "width")
    widths, hexes = _seen(rows, "width", BORDERS), _seen(rows, "hex", BORDERS)
    named = lambda kind: F.concat(F.lit(f"border-{kind}-"), F.col("rank").cast("string"))
    return _rows(widths, ("border", "width"), named("width"), F.col("rank"), "dimension", dimension(F.col("width").cast("string"))).union(
        _rows(hexes, ("border", "color"), named("color"), F.col("rank"), "color", color_value(F.col("hex"))))


def shadows(shadow: DataFrame) -> DataFrame:
    """The six most used shadows: four lengths, 0 where one cannot be read, and a colour, black where it is no #rrggbb."""
    rows = top(shadow.where("confidence <> 'low'"), ["site"], [F.desc("n"), "shadow"], SHADOWS)
    part = lambda k: F.get(F.split(F.trim("shadow"), r"\s+"), k)
    length = lambda k: F.coalesce(dimension(part(k)), F.lit(ZERO))
    tint = F.when(part(4).rlike("^#[0-9a-fA-F]{6}$"), part(4)).otherwise("#000000")
    value = F.concat(F.lit('{"offsetX":'), length(0), F.lit(',"offsetY":'), length(1), F.lit(',"blur":'), length(2), F.lit(',"spread":'), length(3), F.lit(',"color":'), color_value(tint), F.lit("}"))
    return _rows(rows, ("shadow",), F.concat(F.lit("shadow-"), F.col("rank").cast("string")), F.col("rank"), "shadow", value)


def documents(*sections: DataFrame) -> DataFrame:
    """doc_id (the site), json: the sections' tokens as one nested document a site, sections in the given order."""
    out = None
    for k, rows in enumerate(sections):
        of = F.concat(F.lit('{"$type":"'), F.col("type"), F.lit('","$value":'), F.col("value"), F.when(F.col("about").isNotNull(), F.concat(F.lit(',"$description":'), quoted(F.col("about")))).otherwise(""), F.lit("}"))
        own = rows.select(F.col("site").alias("doc_id"), "path", (F.col("ord") + k * 1_000_000).alias("ord"), of.alias("json"))
        out = own if out is None else out.union(own)
    return assemble(out)


def write_documents(docs: DataFrame, path: str) -> None:
    """One text file set a site under path/site=<id>, each document a line."""
    docs.select(F.col("doc_id").alias("site"), "json").repartition("site").write.mode("overwrite").partitionBy("site").text(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, json of what write_documents has written."""
    return spark.read.option("wholetext", True).text(path).select(F.col("site").cast("long").alias("doc_id"), F.rtrim("value").alias("json"))
