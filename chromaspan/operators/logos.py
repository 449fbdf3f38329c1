"""Logos of pages: which marks are the site's own, where they are painted, and which is the best one.

Marks are pictures (img, svg) as rows: page_id, el_id (document order), tag, alt, class, id, src, aria, link (href and link_aria
of the link around it), zone (header, footer or hero, else null), ancestors (array of id and tag, root first), x, y, width, height
(of the content box), natural_width, natural_height, fit, at_x, at_y (object-position), doc_height, and site (the name in its
address), origin. Nulls and unknown values take the defaults that each function states; they never fail a page.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaspan.functions import text
from chromaspan.functions.color import let
from chromaspan.lineage import COMPILED, cut, under

#: What is generic in a logo's alternative text or file name.
GENERIC = (r"(?i)\b(logos?|logotypes?|logomarks?|brandmarks?|wordmarks?|icons?|brands?|marks?)\b", r"(?i)\.(svg|png|webp|avif|jpe?g|gif)\b", r"(?i)\b(on[-_]?white|on[-_]?black|white|black|dark|light|colou?r|mono|full|small|large|[0-9]+x|2x|3x|v?[0-9]{1,4})\b")
#: The points of a region; the least longer edge of a logo; the fold; the height of a footer's band.
REGIONS = {"header": 50, "footer": 20, "hero": 15}
LEAST_EDGE, FOLD, FOOTER_BAND = 24, 500, 1200
#: Marks that make a wall of other brands' logos, how far up they are looked for, and what is no container.
WALL, WALL_LEVELS, OPEN = 3, 3, ("body", "main", "html")


def _finite(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def home_href(href: Column, origin: Column) -> Column:
    """Whether a link leads to the site's own home page, localized ones (/en, /de-at/) included; false for null."""
    h, o = F.lower(F.trim(href)), F.regexp_replace(F.lower(F.trim(F.coalesce(origin, F.lit("")))), "/+$", "")
    own = (o != "") & ((h == o) | F.startswith(h, F.concat(o, F.lit("/"))))
    rest = F.when(own, F.substring(h, F.length(o) + 1, F.length(h))).otherwise(h)
    return F.coalesce((h != "") & (rest.isin("/", "./") | (own & (rest == "")) | rest.rlike(r"^/[a-z]{2}([-_][a-z]{2})?/?$")), F.lit(False))


def region(top: Column, doc_height: Column, fold: int = FOLD) -> Column:
    """header down to the fold (and for unknown places), footer in the last band of a page higher than the band, else body."""
    t, high = _finite(top), _finite(doc_height)
    return F.when(t.isNull() | (t <= fold), "header").when((high > FOOTER_BAND) & (t > high - FOOTER_BAND), "footer").otherwise("body")


def third_party(alt: Column, site: Column) -> Column:
    """The squashed name of another brand in an alternative text or file name; null if there is none or the site is unknown."""
    brand = alt
    for generic in GENERIC:
        brand = F.regexp_replace(brand, generic, " ")
    brand, own = F.lower(F.regexp_replace(brand, "(?i)[^a-z0-9]+", "")), F.lower(site)
    return F.when(own != "", let(brand, lambda b: F.when((F.length(b) >= 2) & ~b.contains(own) & ~own.contains(b), b)))


def position_fraction(token: Column) -> Column:
    """A token of object-position as a share of the free room; 0.5 for pixels and whatever else is not known."""
    t = F.lower(F.trim(token))
    # only what ends as a percentage is cast: a failing cast costs several times as much as all the rest
    share = F.when(t.endswith("%"), F.nullif(F.regexp_extract(t, r"^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)).*%$", 1), F.lit("")).try_cast("double") / 100)
    return F.coalesce(F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).when(t.isin("left", "top"), 0.0).when(t.isin("right", "bottom"), 1.0), F.lit(0.5))


def painted_box(x: Column, y: Column, width: Column, height: Column, natural_width: Column, natural_height: Column, fit: Column, at_x: Column, at_y: Column) -> Column:
    """struct<x, y, width, height>: the part of the content box that the picture fills. contain and scale-down leave room beside it."""
    zero = lambda c: F.coalesce(_finite(c), F.lit(0.0))
    base = [zero(x), zero(y), F.greatest(zero(width), F.lit(0.0)), F.greatest(zero(height), F.lit(0.0))]
    nw, nh = _finite(natural_width), _finite(natural_height)
    boxed = fit.isin("contain", "scale-down") & (nw > 0) & (nh > 0) & (base[2] > 0) & (base[3] > 0)
    scale = F.when(boxed, F.least(base[2] / nw, base[3] / nh, F.when(fit == "scale-down", 1.0)))
    w, h = F.coalesce(nw * scale, base[2]), F.coalesce(nh * scale, base[3])
    return F.struct((base[0] + (base[2] - w) * at_x).alias("x"), (base[1] + (base[3] - h) * at_y).alias("y"), w.alias("width"), h.alias("height"))


def logo_sized(width: Column, height: Column, least: int = LEAST_EDGE) -> Column:
    """Whether the longer edge is long enough for a logo; false for unknown and empty boxes."""
    w, h = _finite(width), _finite(height)
    return F.coalesce((w > 0) & (h > 0) & (F.greatest(w, h) >= least), F.lit(False))


def _sizable() -> Column:
    return (F.col("width") >= 24) & (F.col("height") >= 8)


def walls(marks: DataFrame) -> DataFrame:
    """page_id, up: the containers of at least three sizable marks, open ones (body, main, html) left out. Marks are counted once an ancestor."""
    above = marks.where(_sizable()).select("page_id", F.explode("ancestors").alias("a")).where(~F.lower("a.tag").isin(*OPEN))
    return above.groupBy("page_id", F.col("a.id").alias("up")).agg(F.count("*").alias("n")).where(F.col("n") >= WALL).drop("n")


def asked() -> Column:
    """The containers that a mark asks whether it is one of a wall: its nearest ancestors below the first open one; none for marks
    in headers and in the top strip, and for those that are not sizable."""
    tags = F.transform("ancestors", lambda a: F.lower(a["tag"]))
    top = (F.col("y") < 180) | F.coalesce(F.exists(tags, lambda t: t.isin("header", "nav")), F.lit(False))
    near = F.slice(F.reverse("ancestors"), 1, WALL_LEVELS)
    open_at = F.array_position(F.transform(near, lambda a: F.lower(a["tag"]).isin(*OPEN)), True)
    near = F.when(open_at > 0, F.slice(near, F.lit(1), (open_at - 1).cast("int"))).otherwise(near)
    return F.when(_sizable() & ~F.coalesce(top, F.lit(False)), F.transform(near, lambda a: a["id"]))


def points() -> Column:
    """Points of a mark (with the hosts of its page and of its source, mine and theirs) apart from those of its region (see
    ``region_points``)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    picture = F.lower("tag") == "img"
    file = F.substring_index(F.regexp_replace(low(F.col("src")), "[?#].*$", ""), "/", -1)
    apex = lambda h: F.substring_index(h, ".", -2)
    mine, theirs = F.col("mine"), F.col("theirs")
    w, h = (F.when(picture & (F.col(f"natural_{s}") > 0), F.col(f"natural_{s}")).otherwise(F.col(s)) for s in ("width", "height"))
    names = (F.when(picture, file).otherwise(""), low(F.col("alt")), low(F.col("class")))
    own = F.col("site") != ""
    aria, link = low(F.col("aria")), low(F.col("link"))
    to_home = (link == "/") | (link == F.lower("origin")) | link.endswith(F.concat(F.lit("://"), mine)) | link.endswith(F.concat(F.lit("://"), mine, F.lit("/")))
    tests = [
        (own & (names[0].contains(F.col("site")) | names[1].contains(F.col("site")) | names[2].contains(F.col("site"))), 40), (names[2].contains("logo") | low(F.col("id")).contains("logo"), 30), ((F.lower("tag") == "svg") & (aria.contains("home") | aria.contains("logo")), 40),
        (to_home, 30), (F.col("y") < 200, 10), (F.col("x") < 400, 10), (F.col("y") > 500, -50), (picture & (theirs != "") & ~theirs.endswith(mine) & ~mine.endswith(theirs) & (apex(theirs) != apex(mine)), -60),
        ((w < 20) | (h < 20), -30), ((w > 800) | (h > 500), -80), (~((w > 800) | (h > 500)) & ((w > 600) | (h > 400)), -40), (F.length(names[1]) > 50, -40), ((w > h) & (w < 400) & (w > 40) & (h > 10) & (h < 120), 15)]
    return reduce(add, (F.when(test, worth).otherwise(0) for test, worth in tests)).cast("long")


def region_points(context: Column) -> Column:
    return F.coalesce(*(F.when(context == k, v) for k, v in REGIONS.items()), F.lit(0)).cast("long")


def ranked(marks: DataFrame, most: int = 6) -> DataFrame:
    """page_id, el_id, context, score, rank, box: a page's logos, best first (ties in document order); the first is the logo.

    A mark of a zone counts if its names, its label or its link speak of a logo or of home; a mark named so counts anywhere above
    the fold, and below it if it links home. Other brands and members of walls count only if they link home.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    sure = lambda c: F.coalesce(c, F.lit(False))
    named = F.concat_ws(" ", low(F.col("class")), low(F.col("id")), low(F.col("alt"))).rlike("logo|brand")
    labelled = (F.lower("tag") == "svg") & low(F.col("aria")).rlike("home|logo")
    linked = low(F.col("link")).rlike(r"^/$|^https?://[^/]+/?$") | low(F.col("link_aria")).contains("home")
    home = home_href(F.col("link"), F.col("origin"))
    in_zone = sure(F.col("zone").isin(*REGIONS) & (named | labelled | linked))
    fits = ~((F.col("width") > 1500) | (F.col("height") > 500)) & logo_sized(F.col("width"), F.col("height"))
    swept = sure(named & fits & (F.coalesce(F.col("y") <= FOLD, F.lit(True)) | home))
    by_place = region(F.col("y"), F.col("doc_height"))
    of = lambda when, context, more=0: F.when(when, F.struct((F.col("points") + region_points(context) + more).alias("score"), context.alias("context")))
    box = painted_box(*(F.col(c) for c in ("x", "y", "width", "height", "natural_width", "natural_height", "fit")), F.col("at_x"), F.col("at_y"))
    # in steps, so that what is used more than once is worked out once; a filter on a worked-out column would work it out again
    able = marks.where((F.col("width") > 0) & (F.col("height") > 0) & (in_zone | swept))
    able = able.withColumns({"in_zone": in_zone, "swept": swept, "home": home, "other": third_party(low(F.col("alt")), F.col("site")), "mine": text.host(F.col("origin")), "theirs": text.host(F.col("src"))})
    able = able.withColumns({"points": points(), "at_x": position_fraction(F.col("at_x")), "at_y": position_fraction(F.col("at_y"))})
    with under(marks.sparkSession, COMPILED):
        found = cut(able.select("page_id", "el_id", "home", "other", asked().alias("up"), F.greatest(of(F.col("in_zone"), F.col("zone")), of(F.col("swept"), by_place, 20)).alias("best"), box.alias("box"))).where("home or other is null")
    asks = found.where("not home").select("page_id", "el_id", F.explode("up").alias("up"))
    hit = asks.join(walls(marks), ["page_id", "up"]).select("page_id", "el_id").distinct().withColumn("in_wall", F.lit(True))
    ours = found.join(hit, ["page_id", "el_id"], "left").where("home or in_wall is null")
    order = Window.partitionBy("page_id").orderBy(F.desc("best.score"), "el_id")
    return ours.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("page_id", "el_id", "best.context", "best.score", "rank", "box")


def best_picture(logos: DataFrame, icons: DataFrame) -> DataFrame:
    """page_id, url: what stands for a page. logos: page_id, url, data_uri (of a drawing in the page), one a page; icons: page_id, kind, href, sizes, rank.

    A drawing's own data, else a logo's address if it is a picture's, else icons: for touch, scalable, the largest, any; never a
    picture made for sharing. Pages without any are left out.
    """
    picture = r"(?i)\.(svg|png|jpg|jpeg|webp|gif|avif)(\?.*)?$"
    inside = r"(?i)\.(svg|png|jpg|jpeg|webp|gif|avif)([?&]|$)"
    plain = F.coalesce(F.try_url_decode(F.regexp_replace("url", r"\+", "%2B")), F.lit(""))
    first = logos.select("page_id", F.when(F.col("data_uri").isNotNull(), 0).when(F.col("url").rlike(picture) | plain.rlike(inside), 1).alias("place"), F.lit(0).cast("long").alias("least"), F.coalesce("data_uri", "url").alias("url"))
    shared = F.col("kind").isin("og:image", "twitter:image")
    size = F.coalesce(F.regexp_extract("sizes", r"^\s*([0-9]+)", 1).try_cast("long"), F.lit(0))
    place = F.when(F.col("kind") == "apple-touch-icon", 2).when(F.col("href").endswith(".svg"), 3).when((F.col("sizes") != "") & ~shared, 4).when(~shared, 5)
    rest = icons.select("page_id", place.alias("place"), F.when(place == 4, -size).otherwise(0).cast("long").alias("least"), F.col("href").alias("url"), "rank")
    both = first.withColumn("rank", F.lit(0).cast("long")).unionByName(rest).where("place is not null and url is not null")
    return both.groupBy("page_id").agg(F.min_by("url", F.struct("place", "least", "rank", "url")).alias("url"))
