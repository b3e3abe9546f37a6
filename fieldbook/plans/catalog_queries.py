"""Catalogue queries: species = supplier or part, family = nation, order = region, site = customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.operators import catalog as C
from fieldbook.operators.ranking import placed
from fieldbook.plans.registry import query
from fieldbook.sources.tables import table

_KEY = "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_acctbal AS BIGINT) END"
_MEMBERS = f"WITH mem AS (SELECT s_suppkey, s_name, {_KEY} AS sort, n_name AS family, n_nationkey, r_name AS grp, r_regionkey, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ORDER = "sort NULLS LAST, lower(family), family, lower(s_name), s_name"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their family and group; the sort key is rounded, as the SQL's cast rounds where Spark's would cut."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 7 == 0, None).otherwise(F.rint("s_acctbal").cast("long")).alias("sort"), "s_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("family"), "r_regionkey", F.col("r_name").alias("grp"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))


@query("display_names", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 = 0 THEN nullif(h, '') END, nullif(c, ''), p_name) AS shown, CASE WHEN nullif(h, '') IS NOT NULL AND h <> coalesce(CASE WHEN p_partkey % 4 = 0 THEN nullif(h, '') END, nullif(c, ''), p_name) THEN h END AS historic, p_type AS scientific FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE upper(p_name) END AS c, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name || ' (old)' END AS h FROM part)")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("c", F.expr("CASE WHEN p_partkey % 3 = 0 THEN '' ELSE upper(p_name) END")).withColumn("h", F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(p_name, ' (old)') END"))
    shown, historic = C.display_names(F.col("p_name"), F.col("c"), F.col("h"), F.col("p_partkey") % 4 == 0)
    return p.select("p_partkey", shown.alias("shown"), historic.alias("historic"), F.col("p_type").alias("scientific"))


@query("taxonomic_order", f"{_MEMBERS} SELECT s_suppkey, s_name, family, row_number() OVER (ORDER BY {_ORDER}) AS place FROM mem")
def taxonomic_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one key, family and name go by number; the SQL leaves their order open."""
    return placed(members(spark, sf_dir), [*C.listing_order("sort", "family", "s_name"), F.col("s_suppkey").asc()]).select("s_suppkey", "s_name", "family", "place")


@query("alphabetical_order", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS place FROM part")
def alphabetical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_name").alias("l"), F.lit("").alias("none"), F.format_string("%s\x01%020d", "p_name", "p_partkey").alias("tie"))
    return C.ranked(p, "l", "none", "tie").select("p_partkey", "p_name", "place")


@query("search_aliases", "SELECT p_partkey, p_name || '|' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '|' || p_type END AS aliases FROM part")
def search_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = C.search_aliases(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names, "|").alias("aliases"))


_INDEX = "SELECT '/s/' || s_suppkey AS href, 'species' AS kind, s_name AS name, n_name AS sub, r_name AS grp, 'formerly ' || lower(s_name) || '|' || n_name AS aliases FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT '/c/' || c_custkey, 'site', c_name, n_name, c_mktsegment, '' FROM customer JOIN nation ON c_nationkey = n_nationkey"


@query("search_index", _INDEX)
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = members(spark, sf_dir).select(F.concat(F.lit("/s/"), "s_suppkey").alias("href"), F.lit("species").alias("kind"), F.col("s_name").alias("name"), F.col("family").alias("sub"), "grp", F.concat(F.lit("formerly "), F.lower("s_name"), F.lit("|"), "family").alias("aliases"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/c/"), "c_custkey").alias("href"), F.lit("site").alias("kind"), F.col("c_name").alias("name"), F.col("n_name").alias("sub"), F.col("c_mktsegment").alias("grp"), F.lit("").alias("aliases"))
    return C.search_index(s, c)


_GRAMS = "CASE WHEN length({x}) >= 3 THEN list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring({x}, i, 3))) ELSE [{x}] END"


@query("fuzzy_search", f"""WITH idx AS (SELECT p_partkey AS href, unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS txt, unnest([1.0, 0.5, 0.25]) AS weight FROM part),
tok AS (SELECT href, weight, unnest(list_distinct(regexp_split_to_array(txt, '[^a-z0-9#]+'))) AS token FROM idx),
q AS (SELECT DISTINCT q, lower(q) AS ql FROM (SELECT 'smal rin' AS q UNION ALL SELECT DISTINCT replace(string_split(p_name, ' ')[2], 'i', 'y') FROM part UNION ALL SELECT DISTINCT string_split(p_name, ' ')[1] FROM part) WHERE length(q) >= 2),
pairs AS (SELECT DISTINCT q, ql, token FROM q, (SELECT DISTINCT token FROM tok WHERE token <> '') t WHERE substring(token, 1, 2) = substring(ql, 1, 2) OR len(list_intersect({_GRAMS.format(x='token')}, {_GRAMS.format(x='ql')})) > 0),
near AS (SELECT * FROM (SELECT *, CASE WHEN contains(token, ql) THEN 0.0 ELSE levenshtein(token, ql) / length(ql) END AS miss FROM pairs) WHERE miss <= 0.35),
best AS (SELECT q, href, round(max(weight * (1 - miss)), 6) AS score FROM near JOIN tok USING (token) GROUP BY q, href)
SELECT q, place, href, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, href) AS place FROM best) WHERE place <= 8""")
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    index = p.select(F.col("p_partkey").alias("href"), F.col("p_name").alias("name"), F.col("p_brand").alias("sub"), F.col("p_type").alias("grp"))
    word = lambda k: F.get(F.split("p_name", " "), k)
    q = p.select(F.replace(word(1), F.lit("i"), F.lit("y")).alias("q")).unionByName(p.select(word(0).alias("q"))).unionByName(spark.createDataFrame([("smal rin",)], "q string")).distinct()
    return C.fuzzy_search(index, q, 8).select("q", "place", "href", "score")


@query("text_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(C.text_filter("Ring", "p_name", "p_brand", "p_type")).select("p_partkey", "p_name")


_BOUGHT = "SELECT DISTINCT o_custkey, n_name AS region, n_nationkey AS pos FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, region, pos): where customers bought; a site that lies in several regions."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region"), F.col("n_nationkey").alias("pos"))
    return o.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("o_custkey", "region", "pos").distinct()


@query("site_filter", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({_BOUGHT}) WHERE region = 'NATION_3') AND (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1'))")
def site_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = bought(spark, sf_dir).groupBy("o_custkey").agg(F.collect_set("region").alias("regions"))
    c = table(spark, sf_dir, "customer").join(placed, F.col("c_custkey") == F.col("o_custkey"))
    return c.where(F.array_contains("regions", "NATION_3") & C.text_filter("1", "c_name", "c_mktsegment")).select("c_custkey", "c_name")


@query("group_by_membership", f"WITH b AS ({_BOUGHT}) SELECT b.pos, b.region, b.o_custkey, coalesce(string_agg(o.region, ',' ORDER BY o.pos), '') AS also_in, any_value(t.n) AS total FROM b LEFT JOIN b o ON o.o_custkey = b.o_custkey AND o.region <> b.region JOIN (SELECT region, count(*) AS n FROM b GROUP BY region) t ON t.region = b.region GROUP BY b.pos, b.region, b.o_custkey")
def group_by_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bought(spark, sf_dir)
    sets = b.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("pos", "region"))).alias("r"))
    each = sets.select("o_custkey", "r.region", F.explode("r").alias("own")).select("o_custkey", "own.pos", F.col("own.region").alias("region"), F.array_join(F.array_remove("region", F.col("own.region")), ",").alias("also_in"))
    totals = b.groupBy("region").agg(F.count("*").alias("total"))
    return each.join(totals, "region").select("pos", "region", "o_custkey", "also_in", "total")


@query("publish_guard", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS county FROM orders")
def publish_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").eqNullSafe("F"), F.col("o_orderpriority")).alias("county"))


@query("family_groups", f"{_MEMBERS} SELECT family, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Common ' || family END AS label, count(*) AS members, row_number() OVER (ORDER BY min(place)) AS place FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place FROM mem) GROUP BY family, n_nationkey")
def family_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = C.ranked(members(spark, sf_dir), "sort", "family", "s_name")
    groups = placed.groupBy("family", "n_nationkey").agg(F.count("*").alias("members"), F.min("place").alias("first"))
    labels = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("Common "), "n_name").alias("label"))
    return groups.join(labels, F.col("n_nationkey") == F.col("k"), "left").select("family", "label", "members", F.row_number().over(W.orderBy("first")).alias("place"))  # a row for each family


@query("letter_groups", "SELECT upper(substring(p_name, 1, 1)) AS letter, count(*) AS n FROM part GROUP BY 1")
def letter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.upper(F.substring("p_name", 1, 1)).alias("letter")).agg(F.count("*").alias("n"))


@query("family_members", f"{_MEMBERS} SELECT n_name AS family, s_name, place, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_ORDER}) AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM mem) ON s_nationkey = n_nationkey")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = members(spark, sf_dir)
    m = C.ranked(every, "sort", "family", "s_name", within=["s_nationkey"]).select("s_nationkey", "s_name", "place")
    n = every.groupBy(F.col("s_nationkey").alias("g")).agg(F.count("*").alias("n"))
    f = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("family"))
    return f.join(n, F.col("k") == F.col("g"), "left").join(m, F.col("k") == F.col("s_nationkey"), "left").select("family", "s_name", "place", F.coalesce("n", F.lit(0)).alias("n"))


@query("siblings_topk", f"{_MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_ORDER}) AS place, count(*) OVER (PARTITION BY s_nationkey) - 1 AS total FROM mem) SELECT s_suppkey, sibling, nth, total FROM (SELECT a.s_suppkey, b.s_name AS sibling, a.total, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY b.place) AS nth FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey) WHERE nth <= 15")
def siblings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.siblings(members(spark, sf_dir), "s_nationkey", "s_suppkey", "s_name", C.listing_order("sort", "family", "s_name"), 15)


@query("order_summary", f"{_MEMBERS} SELECT grp, family, count(*) AS n, any_value(total) AS species FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS total FROM mem) WHERE n_nationkey % 6 <> 5 GROUP BY grp, family")
def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families without a record (here every sixth) are not listed but count in the total."""
    m = members(spark, sf_dir)
    total = m.groupBy("grp").agg(F.count("*").alias("species"))
    records = table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").select(F.col("n_nationkey").alias("k"))
    listed = m.join(records, F.col("n_nationkey") == F.col("k"), "left_semi").groupBy("grp", "family").agg(F.count("*").alias("n"))
    return listed.join(total, "grp").select("grp", "family", "n", "species")


@query("flagged_species", "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 <> 0 THEN n_chars END NULLS LAST, lower(source), source, lower(lang), lang, doc_id) AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flagged_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In taxonomic order, here by length (unknown for every seventh), source and language; with the count of the group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")).alias("sort"))
    d = d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    counts = d.groupBy("source").agg(F.count("*").alias("n"))
    return placed(d, [*C.listing_order("sort", "source", "lang"), F.col("doc_id").asc()]).join(counts, "source").select("doc_id", "source", "n", "place")


@query("account_join", "SELECT s_suppkey, s_name, n_name, r_name, count(*) OVER (PARTITION BY s_nationkey) AS in_family FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 8 <> 7 LEFT JOIN region ON n_regionkey = r_regionkey")
def account_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").where("n_nationkey % 8 <> 7")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.join(s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("in_family")), F.col("s_nationkey") == F.col("k")).select("s_suppkey", "s_name", "n_name", "r_name", "in_family")


_FEATURED = (42, 7, 99999999, 3, 11, 5, 2, 8, 13)


@query("featured_lookup", f"SELECT s_suppkey, s_name, i - 1 AS pos FROM (SELECT unnest([{', '.join(map(str, _FEATURED))}]) AS k, unnest(range(1, {len(_FEATURED) + 1})) AS i) JOIN supplier ON s_suppkey = k ORDER BY i LIMIT 6")
def featured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six that exist of a fixed list, in its order."""
    listed = F.array(*map(F.lit, _FEATURED))
    s = table(spark, sf_dir, "supplier").where(F.col("s_suppkey").isin(*_FEATURED))
    return s.select("s_suppkey", "s_name", (F.array_position(listed, F.col("s_suppkey").cast("int")) - 1).alias("pos")).orderBy("pos").limit(6)


@query("sites_by_number", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 50 END, 999), c_custkey) AS place FROM customer")
def sites_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.coalesce(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 50), F.lit(999))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", number.alias("number"))
    return placed(c, [F.col("number").asc(), F.col("c_custkey").asc()], ["c_nationkey"]).select("c_nationkey", "c_custkey", "place")


_PREFERRED = ("purchase", "click", "signup")


@query("ordered_sections", f"SELECT user_id, string_agg(event_type, ',' ORDER BY CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {i}' for i, k in enumerate(_PREFERRED))} ELSE 99 END, event_type) AS sections FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 0) GROUP BY user_id")
def ordered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each user's sections in a fixed order of preference, the others after them."""
    place = F.array_position(F.array(*map(F.lit, _PREFERRED)), F.col("event_type")).cast("int")
    keys = table(spark, sf_dir, "events").where("value > 0").select("user_id", F.when(place > 0, place).otherwise(99).alias("i"), "event_type").distinct()
    return keys.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "event_type"))).alias("s")).select("user_id", F.array_join("s.event_type", ",").alias("sections"))


@query("hero_photo", "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey % 3 <> 0) SELECT l_suppkey, arg_min(l_partkey, CASE WHEN l_partkey % 10 = 1 THEN 0 ELSE 1 END * 100000000 + l_partkey) AS hero, count(*) - 1 AS gallery FROM p GROUP BY l_suppkey")
def hero_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged photo if its asset exists, else the first that does; the rest is the gallery."""
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    assets = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey")
    there = p.join(assets, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return there.groupBy("l_suppkey").agg(F.min_by("l_partkey", F.struct(F.when(F.col("l_partkey") % 10 == 1, 0).otherwise(1), F.col("l_partkey"))).alias("hero"), (F.count("*") - 1).alias("gallery"))


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query("photo_credits", f"SELECT trim({_HOST}) AS name, count(*) AS n, arg_min(url, page_id) FILTER (WHERE contains(url, '?')) AS first_url FROM pages WHERE {_HOST} <> '' GROUP BY 1")
def photo_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.trim(F.expr(_HOST)).alias("name"), F.when(F.contains("url", F.lit("?")), F.col("url")).alias("link")).where("name <> ''")
    return p.groupBy("name").agg(F.count("*").alias("n"), F.min_by("link", F.when(F.col("link").isNotNull(), F.col("page_id"))).alias("first_url"))


@query("credit_usage", f"SELECT name, count(*) AS n, count(DISTINCT url) AS urls, array_to_string(list_sort(list(page_id))[1:40], ',') AS records FROM (SELECT page_id, url, {_HOST} AS name FROM pages) GROUP BY name")
def credit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 records of each name; a window keeps these alone, so that no list grows with the data."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HOST).alias("name"))
    first = p.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("page_id"))).where("k <= 40")
    records = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ",").alias("records"))
    return p.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls")).join(records, "name").select("name", "n", "urls", "records")


_NAMED = "SELECT CASE p_partkey % 3 WHEN 0 THEN nm WHEN 1 THEN upper(nm) || '.' ELSE replace(nm, ' ', ' X ') END AS name, CASE WHEN p_partkey % 97 = 0 THEN 'http://shared.example/' || (p_partkey % 2) || '/' END AS url FROM (SELECT p_partkey, p_name || ' ' || CAST(p_partkey // 3 % 200 AS VARCHAR) AS nm FROM part)"


@query("suspected_variants", f"""WITH RECURSIVE n AS (SELECT DISTINCT name, url FROM ({_NAMED})),
k AS (SELECT DISTINCT name, key FROM (SELECT name, 'p:' || trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS key FROM n
 UNION ALL SELECT name, 's:' || array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: NOT regexp_matches(w, '^[a-z]$')), ' ') FROM n
 UNION ALL SELECT name, 'u:' || rtrim(url, '/') FROM n WHERE url IS NOT NULL)),
r AS (SELECT DISTINCT name, name AS o FROM k UNION SELECT r.name, k2.name FROM r JOIN k k1 ON k1.name = r.o JOIN k k2 ON k2.key = k1.key),
c AS (SELECT name, min(o) AS cluster FROM r GROUP BY name)
SELECT cluster, name FROM c WHERE cluster IN (SELECT cluster FROM c GROUP BY cluster HAVING count(*) > 1)""")
def suspected_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nm = F.concat_ws(" ", "p_name", F.expr("p_partkey DIV 3 % 200").cast("string"))
    third = F.col("p_partkey") % 3
    name = F.when(third == 0, nm).when(third == 1, F.concat(F.upper(nm), F.lit("."))).otherwise(F.replace(nm, F.lit(" "), F.lit(" X ")))
    url = F.when(F.col("p_partkey") % 97 == 0, F.concat(F.lit("http://shared.example/"), (F.col("p_partkey") % 2).cast("string"), F.lit("/")))
    return C.suspected_variants(table(spark, sf_dir, "part").select(name.alias("name"), url.alias("url")).distinct())


_LINE_CREDIT = "CASE l_suppkey % 4 WHEN 0 THEN 'A. Bee' WHEN 1 THEN ' A. Bee ' WHEN 2 THEN 'a. bee' ELSE 'C. Dee' END"
_LINE_URL = "CASE l_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'http://old.example/' END"
_LINK_CREDIT = "CASE length({0}) % 3 WHEN 0 THEN 'A. Bee' ELSE 'E. Eff' END"


def photo_records(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Two collections with photos: orders with a photo for each line, pages with one for each link."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.expr(_LINE_CREDIT).alias("name"), F.expr(_LINE_URL).alias("url")).alias("credit"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    photo = F.struct("at", "credit")
    orders = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(photo)).alias("photos"))  # the lines of one order
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    credit = lambda x: F.when(F.length(x) % 3 == 0, "A. Bee").otherwise("E. Eff")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.transform(links, lambda x: F.struct(x.alias("at"), F.struct(credit(x).alias("name"), x.alias("url")).alias("credit"))).alias("photos"))
    return {"orders": orders, "pages": pages}


_RENAMED = f"""WITH ph AS (SELECT 'orders' AS collection, l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {_LINE_CREDIT}, {_LINE_URL} NULLS FIRST) AS i, {_LINE_CREDIT} AS name, {_LINE_URL} AS url FROM lineitem
  UNION ALL SELECT 'pages', page_id, i, {_LINK_CREDIT.format("l")}, l FROM (SELECT page_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages))),
every AS (SELECT DISTINCT 'orders' AS collection, l_orderkey AS id FROM lineitem UNION ALL SELECT 'pages', page_id FROM pages),
r AS (SELECT collection, id, i, trim(name) = 'A. Bee' AS hit, CASE WHEN trim(name) = 'A. Bee' THEN 'Ann Bee|-' ELSE name || '|' || coalesce(url, '-') END AS c FROM ph)"""


@query("rename_credit", f"{_RENAMED} SELECT every.collection, every.id, coalesce(string_agg(c, ',' ORDER BY i), '') AS credits, count(*) FILTER (WHERE hit) AS renamed FROM every LEFT JOIN r USING (collection, id) GROUP BY 1, 2")
def rename_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'A. Bee' becomes 'Ann Bee' without a link, in both collections; every record as it is then."""
    shown = F.array_join(F.transform("photos", lambda x: F.concat_ws("|", x["credit"]["name"], F.coalesce(x["credit"]["url"], F.lit("-")))), ",")
    parts = [C.rename_credit(t, "A. Bee", "Ann Bee", "").select(F.lit(name).alias("collection"), "id", shown.alias("credits"), "renamed") for name, t in photo_records(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


@query("rename_account", f"{_RENAMED} SELECT collection, count(DISTINCT id) AS records, count(*) AS photos FROM r WHERE hit GROUP BY collection")
def rename_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that renaming touched: records and photos of each collection."""
    return C.rename_account({name: C.rename_credit(t, "A. Bee", "Ann Bee", "") for name, t in photo_records(spark, sf_dir).items()})


@query("editor_index", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END, ''), 'customer ' || c_custkey) AS name, count(o_orderkey) AS photos, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_presence, c_acctbal < 0 AS needs_geocode FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_acctbal")
def editor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("photos"), F.bool_or(F.col("o_orderstatus") == "F").alias("h"))
    name = F.coalesce(F.nullif(F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.col("c_name")), F.lit("")), F.concat(F.lit("customer "), "c_custkey"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", name.alias("name"), F.coalesce("photos", F.lit(0)).alias("photos"), F.coalesce("h", F.lit(False)).alias("has_presence"), (F.col("c_acctbal") < 0).alias("needs_geocode"))
