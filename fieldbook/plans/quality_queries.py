"""Quality gates and audits over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import text as T
from fieldbook.operators import quality as Q
from fieldbook.plans.presence_queries import PM, records
from fieldbook.plans.registry import query
from fieldbook.plans.text_queries import sql_clean, sql_fold, sql_visible
from fieldbook.sources.tables import table


#: The declared schema of an order with its lines.
ORDER = {
    "fields": {
        "id": {"type": "number", "required": True},
        "status": {"required": True, "one_of": ["F", "O"]},
        "priority": {"pattern": "^[1-4]-[A-Z ]+$"},
        "placed": {"required": True, "fields": {"year": {"type": "number", "min": 1993}, "total": {"type": "number", "max": 400000}}},
        "lines": {"required": True, "max_items": 6, "exactly_one": "first", "items": {"fields": {"quantity": {"type": "number", "required": True, "max": 45}, "flag": {"required": True, "one_of": ["A", "N"]}, "first": {"type": "boolean"}}}},
    }
}


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): orders as JSON with their lines; some quantities are words, some flags are missing, orders without lines have no list."""
    line = table(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_partkey") % 50 == 0, "many").otherwise(F.col("l_quantity").cast("string"))).withColumn("f", F.when(F.col("l_suppkey") % 20 != 0, F.col("l_returnflag")))
    one = F.struct("l_linenumber", "q", "f")
    lists = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("l"))  # the lines of one order
    lines = F.transform("l", lambda x: F.struct(x["q"].alias("quantity"), x["f"].alias("flag"), (x["l_linenumber"] == 1).alias("first")))
    o = table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("k"), "left")
    placed = F.struct(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("total"))
    return o.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), placed.alias("placed"), lines.alias("lines"))).alias("text"))


_LINE = "SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, f NULLS FIRST) - 1 AS VARCHAR) AS i, l_linenumber, q, f FROM (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN 'many' ELSE CAST(l_quantity AS VARCHAR) END AS q, CASE WHEN l_suppkey % 20 <> 0 THEN l_returnflag END AS f FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"


@query("schema_issues", f"""WITH l AS ({_LINE}), n AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE l_linenumber = 1) AS h FROM l GROUP BY id)
SELECT o_orderkey AS id, 'status' AS path, 'not one of F, O' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'priority', 'not like ^[1-4]-[A-Z ]+$' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-[A-Z ]+$')
UNION ALL SELECT o_orderkey, 'placed.year', 'under 1993' FROM orders WHERE year(o_orderdate) < 1993
UNION ALL SELECT o_orderkey, 'placed.total', 'over 400000' FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT o_orderkey, 'lines', 'required' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n)
UNION ALL SELECT id, 'lines', 'over 6 items' FROM n WHERE n > 6
UNION ALL SELECT id, 'lines', 'first: not exactly one' FROM n WHERE h <> 1
UNION ALL SELECT id, 'lines.' || i || '.quantity', 'not a number' FROM l WHERE q = 'many'
UNION ALL SELECT id, 'lines.' || i || '.quantity', 'over 45' FROM l WHERE try_cast(q AS DOUBLE) > 45
UNION ALL SELECT id, 'lines.' || i || '.flag', 'required' FROM l WHERE f IS NULL
UNION ALL SELECT id, 'lines.' || i || '.flag', 'not one of A, N' FROM l WHERE f NOT IN ('A', 'N')""")
def schema_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.told(Q.validated(order_texts(spark, sf_dir), "text", ORDER), "id")


_ISSUES = """SELECT doc_id, severity, message FROM (
  SELECT doc_id, 'error' AS severity, doc_id || ': lang is not listed' AS message FROM documents WHERE lang NOT IN ('en', 'fr')
  UNION ALL SELECT doc_id, 'error', doc_id || ': under 400 characters' FROM documents WHERE n_chars < 400
  UNION ALL SELECT doc_id, 'note', doc_id || ': same text as another' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
  UNION ALL SELECT doc_id, 'error', doc_id || ': n_chars is wrong' FROM documents WHERE n_chars <> length(text))"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, severity, message); equal texts are found by their hash, so no text is shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length("text").alias("n"), F.sha2("text", 256).alias("h"))
    twice = d.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", F.lit(True).alias("twice"))
    d = d.join(twice, "h", "left")
    said = lambda m: F.concat(F.col("doc_id").cast("string"), F.lit(": " + m))
    rules = [
        Q.rule(~F.col("lang").isin("en", "fr"), "error", said("lang is not listed")), Q.rule(F.col("n_chars") < 400, "error", said("under 400 characters")),
        Q.rule(F.col("twice"), "note", said("same text as another")), Q.rule(F.col("n_chars") != F.col("n"), "error", said("n_chars is wrong")),
    ]
    return Q.check(d, F.col("doc_id"), rules).withColumnRenamed("where", "doc_id")


@query("check_records", _ISSUES)
def check_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir)


@query("quarantine", f"SELECT doc_id, doc_id IN (SELECT doc_id FROM ({_ISSUES}) WHERE severity = 'error') AS quarantined FROM documents")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    good, bad = Q.split_by(d, "doc_id", issues(spark, sf_dir).where("severity = 'error'"))
    return good.withColumn("quarantined", F.lit(False)).unionByName(bad.withColumn("quarantined", F.lit(True)))


@query("empty_vs_source", "SELECT page_id, CASE WHEN contains(html, '***') THEN 'error' ELSE 'rarity' END AS verdict FROM pages WHERE NOT contains(html, '<table')")
def empty_vs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page from which no table was read is an error only if its source shows the marker."""
    p = table(spark, sf_dir, "pages")
    read = p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("<table"), F.lit(0))).alias("n"), F.contains("html", F.lit("***")).alias("m"))
    return read.where("n = 0").select("page_id", F.when(F.col("m"), "error").otherwise("rarity").alias("verdict"))


@query("check_sites", """SELECT 'site:' || c_custkey AS "where", severity, message FROM (
  SELECT c_custkey, 'error' AS severity, 'unknown region' AS message FROM customer WHERE c_nationkey % 9 = 8
  UNION ALL SELECT c_custkey, 'error', 'one coordinate only' FROM customer WHERE c_custkey % 11 = 0
  UNION ALL SELECT c_custkey, 'pending', 'pin not confirmed' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, 'error', 'no orders' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))""")
def check_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("has", F.lit(True))
    regions = table(spark, sf_dir, "nation").where("n_nationkey % 9 <> 8").select(F.col("n_nationkey").alias("r"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("k"), "left").join(regions, F.col("c_nationkey") == F.col("r"), "left")
    lat, lon = F.col("c_acctbal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    rules = [Q.rule(F.col("r").isNull(), "error", "unknown region"), Q.rule(lat.isNull() != lon.isNull(), "error", "one coordinate only"), Q.rule(lat < 0, "pending", "pin not confirmed"), Q.rule(F.col("has").isNull(), "error", "no orders")]
    return Q.check(c, F.concat(F.lit("site:"), "c_custkey"), rules)


@query("check_references", "SELECT 'unlabelled' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'no document', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'order without items', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'items without order', count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)")
def check_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t, c: table(spark, sf_dir, t).select(F.col(c).cast("string").alias("name"))
    d, lab, o, i = names("documents", "doc_id"), names("labels", "doc_id"), names("orders", "o_orderkey"), names("lineitem", "l_orderkey")
    n = lambda kind, a, b: Q.missing_references(a, b).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("unlabelled", d, lab).unionByName(n("no document", lab, d)).unionByName(n("order without items", o, i)).unionByName(n("items without order", i, o))


_EXPECT = {"region": 5, "nation": 25, "supplier": 100, "part": 2000, "orders": 15000, "labels": 400}


@query("expected_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {n} AS expected, count(*) = {n} AS ok FROM {t}" for t, n in _EXPECT.items()))
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, n in _EXPECT.items():
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(n).alias("expected"), (F.col("n") == n).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out


@query("error_digest", f"SELECT regexp_replace(message, '^[^ ]+: ', '') AS message, count(*) AS n FROM ({_ISSUES}) WHERE severity = 'error' GROUP BY 1 ORDER BY n DESC, message LIMIT 20")
def error_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.error_digest(issues(spark, sf_dir))


_FIELD = {"title": "(?is)<title>(.*?)</title>", "h1": "(?is)<h1>(.*?)</h1>", "footer": "(?is)<footer>(.*?)</footer>"}
_AUDIT = " UNION ALL ".join(f"SELECT page_id, '{f}' AS field, contains({sql_fold(sql_visible('html'))}, substring({sql_fold(sql_clean(f'regexp_extract(html, {chr(39)}{p}{chr(39)}, 1)'))}, 1, 180)) AS ok FROM pages" for f, p in _FIELD.items())


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, field, ok): the start of each extracted field must stand in the text that the page shows.

    Both readings fold alike; the visible text never goes through the extraction's cleaner.
    """
    p = table(spark, sf_dir, "pages")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), T.audit_fold(T.clean_text(F.regexp_extract("html", x, 1), T.ENTITIES)).alias("value")) for f, x in _FIELD.items()])
    seen = p.select("page_id", T.audit_fold(T.visible_text(F.col("html"), T.ENTITIES)).alias("seen"), F.explode(fields).alias("f"))
    return seen.select("page_id", "f.field", F.contains("seen", F.substring("f.value", 1, 180)).alias("ok"))


@query("audit_text_fields", _AUDIT)
def audit_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir)


_ANSWERS = "(SELECT page_id, CASE WHEN kind IS NULL THEN 200 WHEN kind = 'signup' THEN NULL WHEN kind = 'error' THEN 404 WHEN kind = 'click' THEN 503 ELSE 200 END AS status FROM pages LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id) ON user_id = page_id)"


@query("audit_summary", f"SELECT page_id, CASE WHEN status = 200 THEN coalesce(n, 0) ELSE 0 END AS checked, CASE WHEN status = 200 THEN coalesce(bad, 0) ELSE 0 END AS mismatches, CASE WHEN n IS NULL THEN 'missing' WHEN status IS NULL THEN 'unreachable' WHEN status <> 200 THEN 'HTTP ' || status WHEN bad > 0 THEN 'differs' ELSE 'ok' END AS verdict FROM {_ANSWERS} LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad FROM ({_AUDIT}) WHERE page_id % 13 <> 0 GROUP BY page_id) USING (page_id)")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth page has no record; the last event of a page's number says how it answered."""
    p = table(spark, sf_dir, "pages").select("page_id")
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.max_by("event_type", "event_id").alias("kind"))
    status = F.when(F.col("kind") == "error", 404).when(F.col("kind") == "click", 503).when(F.coalesce("kind", F.lit("")) != "signup", 200)
    answers = p.join(last, F.col("page_id") == F.col("u"), "left").select("page_id", status.alias("status"))
    return Q.audit_summary(p, audit(spark, sf_dir).where("page_id % 13 <> 0"), answers, "page_id")


@query("audit_presence_rows", f"{PM} SELECT c.entity, c.region, c.month, CASE WHEN c.month = 7 AND c.region = 'NATION_1' THEN 'missing' WHEN c.rank = 1 AND c.month = 8 THEN 'differs' ELSE 'ok' END AS verdict FROM cells c")
def audit_presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes against a second reading of the source, with faults put in: a missing month, blurred counts."""
    from fieldbook.operators.presence import cells

    ours = cells(records(spark, sf_dir))
    counted = records(spark, sf_dir).groupBy("entity", "region", "month").agg(F.count("*").alias("n"))
    again = counted.select("entity", "region", "month", F.get(F.split(F.lit("I,R,U,F,C"), ","), F.least(F.col("n"), F.lit(5)).cast("int") - 1).alias("code"))
    again = again.where("NOT (month = 7 AND region = 'NATION_1')").withColumn("code", F.when((F.col("code") == "I") & (F.col("month") == 8), "?").otherwise(F.col("code")))
    return Q.same_rows(ours, again, ["entity", "region", "month"], "code")


@query("audit_sets", """SELECT page_id, array_to_string(list_sort(list_filter(src, lambda x: NOT list_contains(ours, x))), ',') AS missing, contains(html, '<script') = regexp_matches(html, '(?i)<script[ >]') AS flags_agree FROM
  (SELECT page_id, html, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS src, list_distinct(regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), 'href="([^"]*[a-z])"', 1)) AS ours FROM pages)""")
def audit_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    src = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    ours = F.regexp_extract_all(F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1), F.lit('href="([^"]*[a-z])"'), F.lit(1))
    return p.select("page_id", F.array_join(F.array_sort(F.array_except(src, ours)), ",").alias("missing"), F.contains("html", F.lit("<script")).eqNullSafe(F.col("html").rlike("(?i)<script[ >]")).alias("flags_agree"))
