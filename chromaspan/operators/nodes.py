"""JSON documents as tables of nodes, pointers between nodes, and documents put together again.

A node is an object, an array or a plain value. ``at`` is its JSON pointer without the leading '#' (the root's is empty),
``up`` its parent's, ``name`` its member name or index, ``ord`` its place among its siblings, ``kind`` object, array,
string, number, boolean or null, ``text`` a plain value's text and ``n`` the number of an object's or array's members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.lineage import cut

#: Members that make an object a token.
TOKEN = ("$value", "$ref")
#: Characters of JSON in a bucket of nodes; a node table takes some twelve times as much memory.
BUCKET = 4_000_000


def buckets_of(documents: DataFrame) -> int:
    """Buckets for the nodes of (doc_id, json): as many as the cluster has cores, and more with the size of the documents."""
    size = documents.agg(F.sum(F.length("json").cast("long"))).first()[0] or 0
    return min(100_000, max(documents.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET)))


def escaped(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def kind_of(value: Column) -> Column:
    said = F.schema_of_variant(value)
    named = [F.when(said.startswith(prefix), name) for prefix, name in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))]
    return F.coalesce(*named, F.lit("number"))


def nodes(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """The nodes of (doc_id, json), a level of nesting a step, with ``path`` (names joined by dots), ``type`` (that of the
    nearest group or token above, for tokens their own) and ``live`` (groups and tokens that can be reached through groups).

    ``held`` objects have a value or a reference of their own; live ones of them but the root are tokens. A document that
    cannot be read, or repeats a member's name, has one node of kind 'invalid' (one that is blank: 'empty').

    Documents are shuffled once, into ``buckets`` (see ``cut``); their nodes stay there.
    """
    spark = documents.sparkSession
    value = F.try_parse_json("json")
    kind = F.when(F.trim(F.coalesce("json", F.lit(""))) == "", "empty").when(F.col("v").isNull(), "invalid").otherwise(kind_of(F.col("v")))
    none = F.lit(None).cast("string")
    level = documents.select("doc_id", "json", value.alias("v")).select("doc_id", F.lit("").alias("at"), none.alias("up"), none.alias("name"), F.lit(0).cast("long").alias("ord"), kind.alias("kind"), F.lit("").alias("path"), none.alias("given"), (kind == "object").alias("live"), "v")
    own = ["doc_id", "at", "up", "name", "ord", "kind", "path", "given", "live"]
    found = []
    while True:
        level = cut(level, by="doc_id", buckets=buckets)
        plain = ~F.col("kind").isin("object", "array", "invalid", "empty")
        found.append(level.select(*own, F.when(plain, F.try_variant_get("v", "$", "string")).alias("text")))
        inner = level.where(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            break
        inner = inner.select("doc_id", F.col("at").alias("up"), F.col("path").alias("above"), "given", "live", "kind", "v")
        rows = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("kind") == "array", F.col("pos").cast("string")).otherwise(F.col("key"))
        rows = rows.select("doc_id", "up", "above", "given", "live", F.col("pos").cast("long").alias("ord"), name.alias("name"), kind_of(F.col("value")).alias("kind"), F.col("value").alias("v"))
        siblings = Window.partitionBy("doc_id", "up")
        token = F.max(F.col("name").isin(*TOKEN)).over(siblings) & (F.col("up") != "")
        said = F.max(F.when((F.col("name") == "$type") & (F.col("kind") == "string"), F.nullif(F.try_variant_get("v", "$", "string"), F.lit("")))).over(siblings)
        dollar = F.col("name").startswith("$") & (F.col("name") != "$root")
        level = rows.select(
            "doc_id", F.concat("up", F.lit("/"), escaped(F.col("name"))).alias("at"), "up", "name", "ord", "kind", F.concat_ws(".", F.nullif("above", F.lit("")), "name").alias("path"),
            F.coalesce(said, "given").alias("given"), (F.col("live") & ~token & ~dollar & F.col("kind").isin("object", "array")).alias("live"), "v")
    whole = []
    for rows, below in zip(found, [*found[1:], found[0].limit(0)], strict=True):
        kids = below.groupBy("doc_id", F.col("up").alias("at")).agg(
            F.count("*").alias("n"), F.bool_or(F.col("name").isin(*TOKEN)).alias("token"), F.max(F.when((F.col("name") == "$type") & (F.col("kind") == "string"), F.nullif("text", F.lit("")))).alias("own"))
        joined = rows.join(kids, ["doc_id", "at"], "left")
        whole.append(joined.select("doc_id", "at", "up", "name", "ord", "kind", "text", "path", "live", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit(False)).alias("held"), (F.col("live") & (F.col("at") != "") & F.coalesce("token", F.lit(False))).alias("token"), F.coalesce("own", "given").alias("type")))
    return cut(*whole, by="doc_id", buckets=buckets)


def followed(edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, at, to, state: where each edge (doc_id, at, to; at once a document) leads in the end; state 'ok', or 'cycle'
    for those that never end. Pointers are doubled until a round ends no further one; what is open then goes round.
    """
    kept = lambda *rows: cut(*rows, by="doc_id", buckets=buckets)
    closed = []
    open_ = kept(edges.select("doc_id", "at", "to"))
    starts = open_.select("doc_id", F.col("at").alias("to"), F.lit(True).alias("on"))
    while True:
        hop = open_.select("doc_id", F.col("at").alias("to"), F.col("to").alias("next"))
        for ended in closed:
            hop = hop.union(ended.select("doc_id", F.col("at").alias("to"), F.col("to").alias("next")))
        step = open_.join(hop, ["doc_id", "to"], "left").select("doc_id", "at", F.coalesce("next", "to").alias("to"))
        step = kept(step.join(starts, ["doc_id", "to"], "left"))
        done = step.where("on is null").select("doc_id", "at", "to")
        if done.isEmpty():
            rest = step.select("doc_id", "at", "to", F.lit("cycle").alias("state"))
            return kept(*(c.select("doc_id", "at", "to", F.lit("ok").alias("state")) for c in closed), rest)
        closed.append(done)
        open_ = step.where("on").select("doc_id", "at", "to")


def assemble(paths: DataFrame) -> DataFrame:
    """doc_id, json: the inverse of flattening: (doc_id, path, ord, json), path an array of member names and json the member's
    own JSON, become one nested object a document, members in the order of their first ord. From the deepest level up,
    a level a step. A document that has no rows has no object; a path must not go on below another's value.
    """
    rows = cut(paths.select("doc_id", "path", "ord", "json"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    member = F.concat(quoted(F.element_at("path", -1)), F.lit(":"), F.col("json"))
    for depth in range(deepest, 0, -1):
        here = rows.where(F.size("path") == depth)
        up = F.slice("path", 1, F.size("path") - 1)
        whole = here.groupBy("doc_id", up.alias("path")).agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", member.alias("said")))).alias("of"))
        whole = whole.select("doc_id", "path", "ord", F.concat(F.lit("{"), F.array_join(F.transform("of", lambda m: m["said"]), ","), F.lit("}")).alias("json"))
        rows = cut(rows.where(F.size("path") < depth).union(whole))
    return rows.select("doc_id", "json")


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
