"""Candidate scoring over parts and documents, spatial joins over the first dimensions of embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import name_tokens
from fieldbook.operators import spatial as S
from fieldbook.operators.ranking import first_k, placed
from fieldbook.plans.registry import query
from fieldbook.plans.text_queries import _STOP
from fieldbook.sources.shared import ready_checkpoints
from fieldbook.sources.tables import table

_POINTS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat, label FROM embeddings"
#: Literal regions: a concave crescent, a square next to it, and a square that overlaps both.
RINGS = (
    ("crescent", ((-0.3, -0.3), (0.3, -0.3), (0.3, -0.1), (-0.1, -0.1), (-0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (-0.3, 0.3))),
    ("hollow", ((-0.1, -0.1), (0.3, -0.1), (0.3, 0.1), (-0.1, 0.1))),
    ("corner", ((0.05, 0.05), (0.4, 0.05), (0.4, 0.4), (0.05, 0.4))),
)
BOX = (-0.2, -0.15, 0.2, 0.25)
_RING_SQL = "(" + " UNION ALL ".join(f"SELECT '{r}' AS region, {[list(p) for p in ps]} AS ring" for r, ps in RINGS) + ")"
_EDGES = f"edges AS (SELECT region, ring[i][1] AS x1, ring[i][2] AS y1, ring[i % len(ring) + 1][1] AS x2, ring[i % len(ring) + 1][2] AS y2 FROM (SELECT region, ring, unnest(range(1, len(ring) + 1)) AS i FROM {_RING_SQL}))"
_CROSS = "(e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("lon"), F.get("embedding", F.lit(1)).cast("double").alias("lat"), "label")


def rings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, [{"lon": x, "lat": y} for x, y in ps]) for r, ps in RINGS], "region string, ring array<struct<lon: double, lat: double>>")


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' / ' || p_brand WHEN 1 THEN p_name || ' (' || p_type || ')' WHEN 2 THEN p_brand || ' - ' || p_name ELSE p_name END"


@query("query_variants", f"SELECT p_partkey, array_to_string(v, '|') AS variants FROM (SELECT p_partkey, list_filter([t, CASE WHEN contains(t, '/') THEN trim(string_split(t, '/')[1]) END, CASE WHEN contains(t, '(') THEN trim(string_split(t, '(')[1]) END, CASE WHEN contains(t, ' - ') THEN trim(string_split(t, ' - ')[-1]) END], lambda x: x IS NOT NULL) AS v FROM (SELECT p_partkey, {_TITLE} AS t FROM part))")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_TITLE).alias("t")).select("p_partkey", F.array_join(S.query_variants(F.col("t")), "|").alias("variants"))


_WANT = f"list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({_STOP}, t)))"
_SCORED = f"""WITH t AS (SELECT p_partkey, p_name, p_size, {_WANT} AS words, CASE p_type WHEN 'ECONOMY' THEN 'strong' WHEN 'STANDARD' THEN 'weak' WHEN 'PROMO' THEN 'reject' ELSE 'other' END AS tier FROM part),
pairs AS (SELECT DISTINCT s.p_partkey AS site, s.words AS want, c.p_partkey AS cand, c.words AS got, c.tier, c.p_size / 100.0 AS imp FROM (SELECT *, unnest(words) AS w FROM t WHERE p_partkey % 100 = 0) s JOIN (SELECT *, unnest(words) AS w FROM t) c ON s.w = c.w AND s.p_partkey <> c.p_partkey),
o AS (SELECT *, CAST(len(list_intersect(want, got)) AS DOUBLE) / len(want) AS overlap FROM pairs),
scored AS (SELECT site, cand, CASE WHEN tier = 'reject' THEN 0 ELSE CASE tier WHEN 'strong' THEN 3.0 WHEN 'weak' THEN 1.0 ELSE 0.25 END + 2 * overlap + 2 * least(imp, 0.5) END AS score, CASE WHEN tier = 'reject' THEN 'rejected by type' ELSE tier || ', name ' || CAST(round(overlap * 100) AS INT) || '%' END AS why FROM o)"""


#: Keys of one list; a pair of lists is one row until it is expanded, and a task holds all that comes of one row.
LIST = 200


def is_site(key: Column) -> Column:
    return key % 100 == 0


def worded(rows: DataFrame) -> DataFrame:
    """rows with the telling words of p_name in its place; those without one are no candidates."""
    return rows.withColumn("words", F.array_sort(name_tokens(F.col("p_name")))).drop("p_name").where("size(words) > 0")


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, p_name, tier, imp) of all parts."""
    tier = F.when(F.col("p_type") == "ECONOMY", "strong").when(F.col("p_type") == "STANDARD", "weak").when(F.col("p_type") == "PROMO", "reject").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", tier.alias("tier"), (F.col("p_size") / 100).alias("imp"))


def roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(site, want) and (cand, got, tier, imp): the sites are a query set, every hundredth part; all other parts are candidates."""
    t = worded(kinds(spark, sf_dir))
    return t.where(is_site(F.col("p_partkey"))).select(F.col("p_partkey").alias("site"), F.col("words").alias("want")).distinct(), t.select(F.col("p_partkey").alias("cand"), F.col("words").alias("got"), "tier", "imp").distinct()


def alike(sites: DataFrame, cands: DataFrame) -> DataFrame:
    """(want, got): sets of words that share one; parts of equal words meet once."""
    s = sites.select("want").distinct().select("want", F.explode("want").alias("w"))
    c = cands.select("got").distinct().select("got", F.explode("got").alias("w"))
    return s.join(c, "w").select("want", "got").distinct()


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def listed(rows: DataFrame, sizes: DataFrame, key: str, within: list[str], out: str) -> DataFrame:
    """(within, out): the keys of each group, repeated ones once, in lists of about LIST; written to a checkpoint.

    sizes: (within, n), rows to be summed by group.  Groups of more than LIST rows are cut by a hash of the key; one row
    in LIST is such a group at most, so these are broadcast, and no task holds a large group.
    """
    ready_checkpoints(rows.sparkSession)
    large = sizes.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)]).agg(F.sum("n").alias("_rows")).where(F.col("_rows") > LIST)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(within)])
    cut = F.coalesce(F.pmod(F.xxhash64(key), F.ceil(F.col("_rows") / LIST)), F.lit(0))
    return rows.join(F.broadcast(large), same, "left").groupBy(*within, cut.alias("_n")).agg(F.collect_set(key).alias(out)).drop("_n").checkpoint()


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(want, sites) and (got, tier, imp, cands): the roles in lists.

    Parts are counted by name before words are made of the names; they are dealt out by key, as a small file is one
    task's.  The sites are taken from the lists of all, so the table is not read again for them.
    """
    parts, of = kinds(spark, sf_dir), [F.col("words").alias("got"), "tier", "imp"]
    counts = worded(parts.groupBy("p_name", "tier", "imp").agg(F.count("*").alias("n"))).select(*of, "n")
    cands = listed(worded(parts.repartition(tasks(spark), "p_partkey")).select(F.col("p_partkey").alias("cand"), *of), counts, "cand", ["got", "tier", "imp"], "cands")
    own = cands.select(F.col("got").alias("want"), F.filter("cands", is_site).alias("own")).where("size(own) > 0")
    return listed(own.select("want", F.explode("own").alias("site")), own.select("want", F.size("own").alias("n")), "site", ["want"], "sites"), cands


@query("score_candidates", f"{_SCORED} SELECT site, cand, round(score, 6) AS score, why FROM scored")
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of sites with equal words and a list of candidates with equal words, tier and size are scored once, dealt out and expanded where they lie."""
    sites, cands = lists(spark, sf_dir)
    pairs = alike(sites, cands).join(sites, "want").join(cands, "got")
    scored = S.score_candidates(pairs, F.col("want"), F.col("got"), F.col("tier"), F.col("imp")).select("sites", "cands", F.round("score", 6).alias("score"), "why")
    dealt = scored.repartition(tasks(spark))
    return dealt.select("sites", F.explode("cands").alias("cand"), "score", "why").select(F.explode("sites").alias("site"), "cand", "score", "why").where("site <> cand")


@query("best_candidate", f"{_SCORED} SELECT p_partkey AS site, cand, round(score, 6) AS score, score >= 2.5 AS accepted FROM part LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, cand) AS r FROM scored) ON site = p_partkey AND r = 1 WHERE p_partkey % 100 = 0")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal candidates the first two serve all sites, and of these the best two serve all sites of equal words: one of them is not the site itself."""
    sites, cands = roles(spark, sf_dir)
    pairs = alike(sites, cands).join(first_k(cands, [F.col("cand").asc()], ["got", "tier", "imp"], 2).drop("place"), "got")
    scored = S.score_candidates(pairs, F.col("want"), F.col("got"), F.col("tier"), F.col("imp")).groupBy("want", "cand").agg(F.max("score").alias("score"))
    lead = first_k(scored, [F.col("score").desc(), F.col("cand").asc()], ["want"], 2).drop("place")
    best = S.best_candidate(sites.join(lead, "want").where("site <> cand"), "site", ["cand"]).select("site", "cand", F.round("score", 6).alias("score"), "accepted")
    every = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("site"))
    return every.join(best, "site", "left")  # nulls where no part shares a word


_SOURCE = "CASE s_suppkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'proposed' WHEN 2 THEN 'placed-by-hand' END"


@query("proposal_state", f"SELECT s_suppkey, CASE WHEN src = 'confirmed' THEN 'skip confirmed' WHEN src IS NOT NULL AND src <> 'proposed' THEN 'skip placed' WHEN s_acctbal >= 2500 THEN 'propose' WHEN src = 'proposed' THEN 'clear' ELSE 'reject' END AS action, CASE WHEN (src IS NULL OR src = 'proposed') AND s_acctbal >= 2500 THEN round(s_acctbal / 1000, 2) END AS lat FROM (SELECT *, {_SOURCE} AS src FROM supplier)")
def proposal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("src", F.expr(_SOURCE))
    good = F.col("s_acctbal") >= 2500
    action = F.when(F.col("src") == "confirmed", "skip confirmed").when(F.col("src").isNotNull() & (F.col("src") != "proposed"), "skip placed").when(good, "propose").when(F.col("src") == "proposed", "clear").otherwise("reject")
    return s.select("s_suppkey", action.alias("action"), F.when((F.col("src").isNull() | (F.col("src") == "proposed")) & good, F.round(F.col("s_acctbal") / 1000, 2)).alias("lat"))


_IN = f"lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}"


@query("within_bounds", f"SELECT id, {_IN} AS inside FROM ({_POINTS})")
def within_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", S.within_bounds(F.col("lat"), F.col("lon"), BOX).alias("inside"))


_K = "cos(radians(0.0))"


@query("project_equirect", f"SELECT id, round(10 + (lon - ({BOX[1]})) * {_K} * k, 6) AS x, round(10 + ({BOX[2]} - lat) * k, 6) AS y FROM ({_POINTS}), (SELECT least((400 - 20) / (({BOX[3]} - ({BOX[1]})) * {_K}), (300 - 20) / ({BOX[2]} - ({BOX[0]}))) AS k)")
def project_equirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = S.project_equirect(F.col("lat"), F.col("lon"), BOX, 400, 300, 10)
    return points(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_PINS = f"SELECT id, lat, lon, CASE WHEN label = 3 THEN 'confirmed' ELSE 'approximate' END AS confidence FROM ({_POINTS}) WHERE {_IN} AND label <> 9"


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with coordinates (label 9 has none) inside the box, and whether they are confirmed (label 3)."""
    p = points(spark, sf_dir).where(S.within_bounds(F.col("lat"), F.col("lon"), BOX) & (F.col("label") != 9))
    return p.select("id", "lat", "lon", F.when(F.col("label").eqNullSafe(3), "confirmed").otherwise("approximate").alias("confidence"))


@query("mappable_pins", _PINS)
def mappable_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins(spark, sf_dir)


@query("awaiting_pin", f"SELECT id, label FROM ({_POINTS}) WHERE id NOT IN (SELECT id FROM ({_PINS}))")
def awaiting_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).join(pins(spark, sf_dir), "id", "left_anti").select("id", "label")


@query("count_by_confidence", f"SELECT count(*) FILTER (WHERE confidence = 'confirmed') AS confirmed, count(*) FILTER (WHERE confidence = 'approximate') AS approximate, count(*) FILTER (WHERE confidence IS NULL) AS unplaced FROM embeddings LEFT JOIN ({_PINS}) ON id = vec_id")
def count_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return points(spark, sf_dir).select("id").join(pins(spark, sf_dir), "id", "left").agg(F.count_if(c == "confirmed").alias("confirmed"), F.count_if(c == "approximate").alias("approximate"), F.count_if(c.isNull()).alias("unplaced"))


_FIT = f"(SELECT min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM ({_POINTS}) WHERE label <> 0)"


@query("fit_bbox_transform", f"SELECT id, round(-124 + (lon - a) / (b - a) * 7, 3) AS x, round(49 - (lat - c) / (d - c) * 4, 3) AS y FROM ({_POINTS}), {_FIT}")
def fit_bbox_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of all groups but label 0 is mapped to a box; one row of figures is joined back."""
    p = points(spark, sf_dir)
    fit = p.where("label <> 0").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min("lat").alias("c"), F.max("lat").alias("d"))
    f = fit.select(F.struct("a", "b", "c", "d").alias("f")).scalar()
    q = p.select("id", "lon", "lat", f.alias("f"))
    return q.select("id", F.round(-124 + (F.col("lon") - F.col("f.a")) / (F.col("f.b") - F.col("f.a")) * 7, 3).alias("x"), F.round(49 - (F.col("lat") - F.col("f.c")) / (F.col("f.d") - F.col("f.c")) * 4, 3).alias("y"))


@query("ring_extents", f"SELECT label, count(*) AS n, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM ({_POINTS}) GROUP BY label")
def ring_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query("point_in_polygon_join", f"WITH {_EDGES} SELECT p.id, e.region FROM ({_POINTS}) p, edges e GROUP BY p.id, e.region HAVING sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1")
def point_in_polygon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.point_in_polygon_join(points(spark, sf_dir), rings(spark)).select("id", "region")


_EXT = f"(SELECT label, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM ({_POINTS}) GROUP BY label)"


_QUAD = "list_transform([[w, (s + n) / 2], [(w + e) / 2, s], [e, (s + n) / 2], [(w + e) / 2, n]], lambda p: {'x': p[1], 'y': p[2]})"
_LABEL = f"""WITH ext AS {_EXT}, ring AS (SELECT CAST(label AS VARCHAR) AS region, w, e, s, n, {_QUAD} AS r FROM ext),
g AS (SELECT region, r, i, j, w + (e - w) * i / 24 AS lon, s + (n - s) * j / 24 AS lat FROM ring, range(1, 24) AS t(i), range(1, 24) AS u(j)),
ins AS (SELECT *, len(list_filter([1, 2, 3, 4], lambda k: (r[k].y > lat) <> (r[k % 4 + 1].y > lat) AND lon < (r[k % 4 + 1].x - r[k].x) * (lat - r[k].y) / (r[k % 4 + 1].y - r[k].y) + r[k].x)) % 2 = 1 AS inside FROM g),
d AS (SELECT *, round(list_min(list_transform(r, lambda p: (p.x - lon) ** 2 + (p.y - lat) ** 2)), 12) AS d FROM ins WHERE inside),
best AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY region ORDER BY d DESC, i, j) = 1)
SELECT region, round(coalesce(best.lon, list_avg(list_transform(ring.r, lambda p: p.x))), 4) AS lon, round(coalesce(best.lat, list_avg(list_transform(ring.r, lambda p: p.y))), 4) AS lat FROM ring LEFT JOIN best USING (region)"""


@query("label_point", _LABEL)
def label_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the quadrilaterals that span the labels' extents (their corners cut towards the middle)."""
    e = points(spark, sf_dir).groupBy("label").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"))
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    ring = F.array(p(F.col("w"), mid("s", "n")), p(mid("w", "e"), F.col("s")), p(F.col("e"), mid("s", "n")), p(mid("w", "e"), F.col("n")))
    return S.label_point(e.select(F.col("label").cast("string").alias("region"), ring.alias("ring")))


@query("region_adjacency", f"SELECT DISTINCT a.label AS a, b.label AS b FROM ({_POINTS}) a JOIN ({_POINTS}) b ON a.label < b.label AND sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) < 0.001")
def region_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_groups(points(spark, sf_dir).select(F.col("label").alias("grp"), F.col("lon").alias("x"), F.col("lat").alias("y")), 0.001)


@query("sampled_overlap", f"WITH {_EDGES}, hit AS (SELECT p.id, e.region FROM ({_POINTS}) p, edges e GROUP BY p.id, e.region HAVING sum(CASE WHEN {_CROSS} THEN 1 ELSE 0 END) % 2 = 1) SELECT count(*) AS covered, count(*) FILTER (WHERE n >= 2) AS doubly, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS share FROM (SELECT id, count(*) AS n FROM hit GROUP BY id)")
def sampled_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the covered points that two regions or more cover; the embeddings are the sample points."""
    hit = S.point_in_polygon_join(points(spark, sf_dir), rings(spark)).groupBy("id").agg(F.count("*").alias("n"))
    return hit.agg(F.count("*").alias("covered"), F.count_if(F.col("n") >= 2).alias("doubly")).select("covered", "doubly", F.round(F.col("doubly") / F.col("covered"), 6).alias("share"))


@query("pin_edits", "WITH e AS (SELECT user_id AS site, arg_max(event_type, event_id) AS kind, arg_max(round(value, 5), event_id) AS v FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup') GROUP BY 1) SELECT s_suppkey, CASE WHEN kind = 'error' THEN NULL WHEN kind = 'click' THEN v ELSE round(s_acctbal, 5) END AS lat, CASE kind WHEN 'click' THEN 'placed-by-hand' WHEN 'error' THEN NULL WHEN 'purchase' THEN CASE WHEN s_acctbal IS NOT NULL THEN 'confirmed' END WHEN 'signup' THEN 'placed-by-hand' ELSE 'proposed' END AS source FROM supplier LEFT JOIN e ON site = s_suppkey")
def pin_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last edit of each site: click moves the pin, error clears it, purchase confirms, signup takes that back."""
    log = table(spark, sf_dir, "events").where("event_type IN ('click', 'error', 'purchase', 'signup')").groupBy(F.col("user_id").alias("site")).agg(F.max_by(F.struct("event_type", F.round("value", 5).alias("v")), "event_id").alias("e"))
    s = table(spark, sf_dir, "supplier").join(log, F.col("s_suppkey") == F.col("site"), "left")
    kind, own = F.col("e.event_type"), F.round("s_acctbal", 5)
    lat = F.when(kind == "error", None).when(kind == "click", F.col("e.v")).otherwise(own)
    source = F.when(kind.isNull(), "proposed").when(kind.isin("click", "signup"), "placed-by-hand").when(kind == "purchase", F.when(own.isNotNull(), "confirmed"))
    return s.select("s_suppkey", lat.alias("lat"), source.alias("source"))


@query("focus_extent", f"WITH f AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM ({_POINTS}) WHERE label = 2), u AS (SELECT lon, lat FROM ({_POINTS}), f WHERE label = 2 OR (lon BETWEEN w - 0.35 * (e - w) AND e + 0.35 * (e - w) AND lat BETWEEN s - 0.35 * (n - s) AND n + 0.35 * (n - s))) SELECT min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM u")
def focus_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    focus = F.col("label") == 2
    f = p.where(focus).agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n")).select(F.struct("w", "e", "s", "n").alias("f")).scalar()
    q = p.select("*", f.alias("f"))
    dx, dy = 0.35 * (F.col("f.e") - F.col("f.w")), 0.35 * (F.col("f.n") - F.col("f.s"))
    near = F.col("lon").between(F.col("f.w") - dx, F.col("f.e") + dx) & F.col("lat").between(F.col("f.s") - dy, F.col("f.n") + dy)
    return q.where(focus | near).agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))
