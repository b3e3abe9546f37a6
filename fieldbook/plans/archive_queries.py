"""Archive queries over pages, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import asset_name
from fieldbook.operators import archive as A
from fieldbook.plans.registry import query
from fieldbook.plans.text_queries import _ASSET
from fieldbook.sources.tables import table

HOSTS = r"\.example\.(?:com|net)$"
PAGES, ASSETS = (r"^/?$", r"^/[a-z]{2}/\d+$"), (r"(?i)^/(?:images|css|js)/[^/]+$", r"(?i)\.(?:ico|png|jpg|css|js)$")
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1)"
_CANON = f"CASE WHEN regexp_matches({_HOST}, '\\.example\\.(?:com|net)$') AND {_PATH} <> '' THEN lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} || {_PATH} END"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


#: The pages again as those of one site below a root segment that is written in three ways, each with links of every kind.
SITE = A.Site("http://www.example.com", HOSTS, "/wiki/", (r"^/wiki/$", r"^/wiki/[a-z]{2}/[0-9]+$"), (r"^/wiki/(?:[^/]+/)*images/[^/]+$", r"^/wiki/(?:css|js)/[^/]+$"), (("https://cdn.other.net/lib.js", "vendor/lib.js"),))
_SITE_URL = "regexp_extract(url, '^([a-z]+://[^/]*)', 1) || CASE page_id % 3 WHEN 0 THEN '/Wiki' WHEN 1 THEN '/WIKI' ELSE '/wiki' END || regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1)"
_N = object()  # stands for the page's number
_LINK_PARTS = (
    """<style>.h{background:url("/Wiki/images/h""", _N, """.png")} .b{background:url( ../images/b.gif )}</style><script>var u="http:\\/\\/countries.www.a.example.com\\/WIKI\\/en\\/""", _N,
    """";$("#s").css("background","url(\\"https://m.b.example.net/wiki/images/s.jpg\\")")</script><a href="http://elsewhere.test/x">x</a><a href="https://m.Q.example.com/WIKI/fr/""", _N,
    """?a=1&amp;b=2#f">y</a><a href="/wiki/">top</a><a href="mailto:a@b.c">m</a><img src="images/p""", _N, """_s.JPG" style="background:url('/wiki/css/x.css')"><script src="https://cdn.other.net/lib.js"></script><script src="/WIKI/js/own.js"></script>""",
)
_SITE_HTML = "html || " + " || ".join("CAST(page_id AS VARCHAR)" if x is _N else "'" + x.replace("'", "''") + "'" for x in _LINK_PARTS)
_SITE_PAGES = f"(SELECT page_id, {_SITE_URL} AS url, {_SITE_HTML} AS html FROM pages)"


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.expr(_SITE_URL).alias("url"), F.concat("html", *[F.col("page_id").cast("string") if x is _N else F.lit(x) for x in _LINK_PARTS]).alias("html"))


def _canon(u: str) -> str:
    """SQL of the canonical form within SITE."""
    host, path = f"regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)", f"regexp_extract({u}, '^[A-Za-z]+://[^/?#]*(/[^?#]*)', 1)"
    return f"CASE WHEN regexp_matches(lower({host}), '\\.example\\.(?:com|net)$') AND regexp_matches({path}, '(?i)^/wiki(?:/|$)') THEN 'http://www.example.com/wiki/' || regexp_replace({path}, '(?i)^/wiki/?', '') END"


def _site_kind(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '^http://www.example.com/wiki/(?:[a-z]{{2}}/[0-9]+)?$') THEN 'page' WHEN regexp_matches({u}, '^http://www.example.com/wiki/(?:(?:[^/]+/)*images|css|js)/[^/]+$') THEN 'asset' END"


def _absolute(link: str) -> str:
    """SQL of a link of these pages as an absolute URL; they step up one folder at most, at their start."""
    folder = "regexp_extract(src, '^([A-Za-z]+://[^?#]*/)', 1)"
    return f"regexp_replace(CASE WHEN regexp_matches({link}, '^[A-Za-z]+:') THEN {link} WHEN starts_with({link}, '/') THEN regexp_extract(src, '^([A-Za-z]+://[^/?#]*)', 1) || {link} ELSE {folder} || {link} END, '/[^/]+/\\.\\./', '/')"


@query("canonical_url", f"SELECT page_id, {_CANON} AS canonical, {_canon('site_url')} AS in_site FROM (SELECT page_id, url, {_SITE_URL} AS site_url FROM pages)")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the page's own host, and as one site: one origin, one case of the root."""
    return pages(spark, sf_dir).select("page_id", A.canonical_url(F.col("url"), HOSTS).alias("canonical"), SITE.canonical(F.expr(_SITE_URL)).alias("in_site"))


_PATH0 = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
_KIND = f"CASE WHEN regexp_matches({_PATH0}, '^/?$|^/[a-z]{{2}}/[0-9]+$') THEN 'page' WHEN regexp_matches({_PATH0}, '(?i)^/(?:images|css|js)/[^/]+$|\\.(?:ico|png|jpg|css|js)$') THEN 'asset' END"


@query("url_kind", f"SELECT page_id, {_KIND} AS kind FROM pages")
def url_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", A.url_kind(F.col("url"), PAGES, ASSETS).alias("kind"))


@query("archive_path", f"SELECT page_id, CASE WHEN regexp_replace({_PATH0}, '^/', '') = '' THEN 'pages/index.html' WHEN {_KIND} = 'asset' THEN 'assets/' || regexp_replace({_PATH0}, '^/', '') ELSE 'pages/' || regexp_replace({_PATH0}, '^/', '') || '.html' END AS path FROM pages")
def archive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", A.archive_path(F.col("url"), F.coalesce(A.url_kind(F.col("url"), PAGES, ASSETS), F.lit(""))).alias("path"))


_NAME = "CASE p_partkey % 5 WHEN 0 THEN p_partkey || '_s.jpg' WHEN 1 THEN p_partkey || '_t.PNG' WHEN 2 THEN p_partkey || '_l.gif' WHEN 3 THEN p_partkey || '.jpg' ELSE p_partkey || '_x.jpg' END"


@query("variant_siblings", f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p || '_t.jpg,' || p || '_l.jpg,' || p || '.jpg' WHEN 1 THEN p || '_s.PNG,' || p || '_l.PNG,' || p || '.PNG' WHEN 2 THEN p || '_s.gif,' || p || '_t.gif,' || p || '.gif' ELSE '' END AS siblings FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS p FROM part)")
def variant_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.variant_siblings(F.expr(_NAME)), ",").alias("siblings"))


_OWN = A.IN_TEXT.replace("'", "''")
_LINKS = f"""(SELECT page_id, CAST(pos AS INT) AS pos, src, dst, {_site_kind("dst")} AS kind FROM (SELECT page_id, pos, src, {_canon("a")} AS dst FROM (SELECT page_id, i - 1 AS pos, src, {_absolute("link")} AS a
  FROM (SELECT page_id, src, unnest(ls) AS link, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page_id, url AS src, regexp_extract_all(html, '(?i)(?:href|src|data-large_file|data-image_url)\\s*=\\s*["'']([^"'']+)["'']', 1)
    || regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1) || regexp_extract_all(html, '(?is)<[a-z][^<>]*\\sstyle\\s*=\\s*"([^"]*)"', 1), chr(10)), '(?i)url\\(\\s*["'']?([^"'')]+?)["'']?\\s*\\)', 1)
    || list_transform(regexp_extract_all(html, '{_OWN}'), lambda x: replace(x, '\\/', '/')) AS ls FROM {_SITE_PAGES}))
  WHERE NOT regexp_matches(link, '(?i)^(?:mailto:|javascript:|data:|#|tel:)'))) WHERE {_site_kind("dst")} IS NOT NULL)"""


@query("extract_links", f"SELECT page_id, pos, src, dst FROM {_LINKS}")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extract_links(site_pages(spark, sf_dir), SITE)


@query("wrapper_links", "SELECT DISTINCT 'http://origin.example/wrapper?id=' || regexp_extract(url, '[?&]page=([0-9]+)', 1) || '&type=' || regexp_extract(url, '[?&]ref=([A-Za-z]+)', 1) AS wrapper FROM pages WHERE regexp_matches(url, '[?&]page=[0-9]+&ref=[A-Za-z]+')")
def wrapper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.regexp_extract("url", r"[?&]page=([0-9]+)&ref=([A-Za-z]+)", k)
    return pages(spark, sf_dir).where(at(1) != "").select(F.concat(F.lit("http://origin.example/wrapper?id="), at(1), F.lit("&type="), at(2)).alias("wrapper")).distinct()


_LOG = f"(SELECT {_canon('url')} AS url, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, event_id AS seq FROM events JOIN {_SITE_PAGES} ON page_id = user_id WHERE event_type IN ('error', 'view') UNION ALL SELECT 'http://www.example.com/wiki/images/h' || user_id || '.png', CASE WHEN event_type = 'signup' THEN 404 ELSE 200 END, event_id FROM events WHERE event_type IN ('signup', 'click'))"


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, seq): errors and views of pages, and of their images; a page may fail and be fetched later, or the other way about."""
    e = table(spark, sf_dir, "events")
    p = site_pages(spark, sf_dir).select("page_id", SITE.canonical(F.col("url")).alias("url"))
    of_pages = e.where("event_type IN ('error', 'view')").join(p, F.col("page_id") == F.col("user_id")).select("url", F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"), F.col("event_id").alias("seq"))
    image = F.concat(F.lit("http://www.example.com/wiki/images/h"), F.col("user_id").cast("string"), F.lit(".png"))
    return of_pages.unionByName(e.where("event_type IN ('signup', 'click')").select(image.alias("url"), F.when(F.col("event_type") == "signup", 404).otherwise(200).alias("status"), F.col("event_id").alias("seq")))


_FOUND = f"""(SELECT page_id, pos, src, 0 AS k, dst AS url FROM {_LINKS} UNION ALL SELECT page_id, pos, src, k, regexp_replace(dst, '(?i)_([stl])\\.(jpg|jpeg|gif|png)$', '') || CASE k WHEN 1 THEN CASE WHEN v = 's' THEN '_t' ELSE '_s' END WHEN 2 THEN CASE WHEN v = 'l' THEN '_t' ELSE '_l' END ELSE '' END || regexp_extract(dst, '(\\.[A-Za-z]+)$', 1)
  FROM (SELECT *, lower(regexp_extract(dst, '(?i)_([stl])\\.(?:jpg|jpeg|gif|png)$', 1)) AS v FROM {_LINKS}), unnest([1, 2, 3]) AS t(k) WHERE v <> '')"""


@query("crawl_frontier", f"""WITH f AS {_FOUND}, done AS (SELECT url FROM (SELECT url, arg_max(status, seq) AS status FROM {_LOG} GROUP BY url) WHERE status = 200),
first AS (SELECT * FROM f WHERE url NOT IN (SELECT url FROM done WHERE url IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, pos, k) = 1)
SELECT CASE {_site_kind("url")} WHEN 'page' THEN 0 WHEN 'asset' THEN 1 END AS tier, url, src AS referrer, page_id, pos FROM first WHERE {_site_kind("url")} IS NOT NULL""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.crawl_frontier(A.extract_links(site_pages(spark, sf_dir), SITE), fetch_log(spark, sf_dir), SITE)


@query("reachable_set", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), r(node, hops) USING KEY (node) AS (SELECT 0::BIGINT AS node, 0 AS hops UNION SELECT DISTINCT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE e.dst NOT IN (SELECT node FROM recurring.r)) SELECT node, hops FROM r")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return A.reachable_set(e, spark.range(1).select(F.col("id").alias("node")))


@query("verify_integrity", "SELECT page_id AS path, CASE WHEN page_id % 17 = 0 THEN 'not fetched' WHEN page_id % 19 = 0 THEN 'missing' WHEN page_id % 23 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM pages")
def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    manifest = p.select("path", F.sha2("content", 256).alias("sha256"), F.when(F.col("path") % 17 == 0, 404).otherwise(200).alias("status"))
    files = p.where("path % 19 <> 0").withColumn("content", F.when(F.col("path") % 23 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return A.verify_integrity(manifest, files)


_H = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query("coverage_vs_expected", f"SELECT h AS host, n AS got, 3 AS expected, 3 - n AS shortfall FROM (SELECT {_H} AS h, count(*) AS n FROM pages GROUP BY 1) WHERE n < 3")
def coverage_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pages(spark, sf_dir).groupBy(F.expr(_H).alias("host")).agg(F.count("*").alias("got"))
    return got.select("host", "got", F.lit(3).alias("expected"), F.greatest(3 - F.col("got"), F.lit(0)).alias("shortfall")).where("shortfall > 0")


@query("missing_at_source", f"SELECT DISTINCT {_ASSET} AS name FROM pages WHERE page_id IN (SELECT user_id FROM events WHERE event_type = 'error') AND {_ASSET} IS NOT NULL")
def missing_at_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what failed in any log row, not in the latest alone; the user of an error stands for the page."""
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("page_id"))
    return pages(spark, sf_dir).join(failed, "page_id", "left_semi").select(asset_name(F.col("url")).alias("name")).where("name IS NOT NULL").distinct()


_INDEX = f"(SELECT {_canon('url')} AS url FROM {_SITE_PAGES} WHERE page_id % 5 <> 0 UNION SELECT dst FROM {_LINKS} WHERE kind = 'asset' AND page_id % 4 <> 0)"
_STORED = "CASE WHEN {0} LIKE '%/wiki/' THEN 'pages/index.html' WHEN " + _site_kind("{0}").replace("{2}", "{{2}}") + " = 'asset' THEN 'assets/' || substr({0}, 29) ELSE 'pages/' || substr({0}, 29) || '.html' END"
_CUT = "(?i)((?:href|src|data-large_file|data-image_url)\\s*=\\s*[\"''])([^\"'']+)([\"''])|" + _OWN
_REWRITTEN = f"""WITH p AS (SELECT page_id, url AS src, html, {_STORED.format(_canon("url"))} AS path FROM {_SITE_PAGES} WHERE {_site_kind(_canon("url"))} = 'page'),
idx AS (SELECT url, {_STORED.format("url")} AS to_path FROM {_INDEX}),
m AS (SELECT page_id, src, path, unnest(w) AS whole, unnest(l) AS link, unnest(b) AS before, unnest(a) AS after, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, regexp_extract_all(html, '{_CUT}', 0) AS w, regexp_extract_all(html, '{_CUT}', 1) AS b, regexp_extract_all(html, '{_CUT}', 2) AS l, regexp_extract_all(html, '{_CUT}', 3) AS a FROM p)),
d AS (SELECT *, {_canon(_absolute("raw"))} AS dst FROM (SELECT *, CASE WHEN link <> '' THEN link ELSE replace(whole, '\\/', '/') END AS raw FROM m)),
t AS (SELECT d.*, CASE WHEN link = 'https://cdn.other.net/lib.js' THEN 'vendor/lib.js' ELSE to_path END AS to_path FROM d LEFT JOIN idx ON idx.url = dst AND NOT regexp_matches(raw, '(?i)^(?:mailto:|javascript:|data:|#|tel:)')),
r AS (SELECT page_id, i, to_path IS NOT NULL AS done, CASE WHEN to_path IS NULL THEN whole ELSE coalesce(before, '') || CASE WHEN path = 'pages/index.html' THEN CASE WHEN to_path LIKE 'pages/%' THEN substr(to_path, 7) ELSE '../' || to_path END
  WHEN to_path LIKE 'pages/__/%' AND substr(to_path, 1, 9) = substr(path, 1, 9) THEN substr(to_path, 10) WHEN to_path LIKE 'pages/%' THEN '../' || substr(to_path, 7) ELSE '../../' || to_path END || coalesce(after, '') END AS txt FROM t),
l AS (SELECT page_id, list(txt ORDER BY i) AS txts, count(*) FILTER (WHERE done) AS n FROM r GROUP BY page_id)
SELECT page_id, path, sha256(array_to_string(list_transform(range(1, len(parts) + 1), lambda k: parts[k] || coalesce(txts[k], '')), '')) AS sha, coalesce(n, 0) AS replaced FROM (SELECT page_id, path, regexp_split_to_array(html, '{_CUT}') AS parts FROM p) LEFT JOIN l USING (page_id)"""


@query("rewrite_links", _REWRITTEN)
def rewrite_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five pages, and what assets three of four pages name, are archived."""
    p = site_pages(spark, sf_dir)
    links = A.extract_links(p.where("page_id % 4 <> 0"), SITE)
    urls = p.where("page_id % 5 <> 0").select(SITE.canonical(F.col("url")).alias("url")).union(links.where(SITE.kind(F.col("dst")) == "asset").select("dst")).distinct()
    return A.rewrite_links(p, SITE, urls.select("url", SITE.path(F.col("url")).alias("path"))).select("page_id", "path", F.sha2("html", 256).alias("sha"), "replaced")


@query("strip_tracking", "SELECT page_id, sha256(regexp_replace(html, '(?is)<script\\b[^>]*>(?:var [a-z]=\"[^\"]*\";)?track\\([^<]*</script>', '', 'g')) AS sha, strlen(regexp_replace(html, '(?is)<script\\b[^>]*>(?:var [a-z]=\"[^\"]*\";)?track\\([^<]*</script>', '', 'g')) AS bytes FROM pages")
def strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("html", r"""(?is)<script\b[^>]*>(?:var [a-z]="[^"]*";)?track\([^<]*</script>""", "")
    return pages(spark, sf_dir).select("page_id", F.sha2(bare, 256).alias("sha"), F.octet_length(bare).cast("long").alias("bytes"))


@query("archive_inventory", f"SELECT coalesce({_KIND}, 'other') AS kind, count(*) AS n, sum(strlen(html)) AS bytes FROM pages GROUP BY 1")
def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(F.coalesce(A.url_kind(F.col("url"), PAGES, ASSETS), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


_REFS = "SELECT DISTINCT CAST(p_partkey AS VARCHAR) || '.jpg' AS file, 'species' AS dest, 1 AS prio FROM part UNION SELECT DISTINCT CAST(l_partkey AS VARCHAR) || '.jpg', 'sites', 2 FROM lineitem UNION SELECT DISTINCT CAST(s_suppkey AS VARCHAR) || '.jpg', 'ecoregions', 3 FROM supplier"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda t, c, d, n: table(spark, sf_dir, t).select(F.concat(F.col(c).cast("string"), F.lit(".jpg")).alias("file"), F.lit(d).alias("dest"), F.lit(n).alias("prio"))
    every = ref("part", "p_partkey", "species", 1).unionByName(ref("lineitem", "l_partkey", "sites", 2)).unionByName(ref("supplier", "s_suppkey", "ecoregions", 3))
    return every.groupBy("file").agg(F.max_by("dest", "prio").alias("dest"))


@query("asset_job_plan", f"SELECT file, arg_max(dest, prio) AS dest, 'image' AS kind FROM ({_REFS}) GROUP BY file UNION ALL SELECT DISTINCT CAST(p_partkey // 2 AS VARCHAR) || '.mp3', 'audio', 'audio' FROM part WHERE p_partkey % 4 <> 3")
def asset_job_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each image, the last collection that refers to it wins; recordings, here one for two parts, are kept apart and go to one place."""
    audio = table(spark, sf_dir, "part").where("p_partkey % 4 <> 3").select(F.concat(F.expr("p_partkey DIV 2").cast("string"), F.lit(".mp3")).alias("file")).distinct()
    return jobs(spark, sf_dir).select("file", "dest", F.lit("image").alias("kind")).unionByName(audio.select("file", F.lit("audio").alias("dest"), F.lit("audio").alias("kind")))


@query("best_rendition", "SELECT p_partkey || '_s.jpg' AS name, CASE WHEN p_partkey % 4 = 0 THEN p_partkey || '.JPG' WHEN p_partkey % 4 = 1 THEN p_partkey || '_L.jpg' WHEN p_partkey % 4 = 2 THEN p_partkey || '_t.jpg' END AS file FROM part")
def best_rendition(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    names = p.select(F.concat(k, F.lit("_s.jpg")).alias("name"))
    r = F.col("p_partkey") % 4
    made = F.when(r == 0, F.array(F.lit(".JPG"), F.lit("_t.jpg"))).when(r == 1, F.array(F.lit("_L.jpg"), F.lit("_t.jpg"))).when(r == 2, F.array(F.lit("_t.jpg"), F.lit("_s.jpg"))).otherwise(F.array().cast("array<string>"))
    return A.best_rendition(names, p.select(k.alias("k"), F.explode(made).alias("v")).select(F.concat("k", "v").alias("file")))


@query("asset_job_status", f"WITH j AS (SELECT file, arg_max(dest, prio) AS dest FROM ({_REFS}) GROUP BY file) SELECT dest, CASE WHEN CAST(replace(file, '.jpg', '') AS BIGINT) % 7 <> 0 THEN 'present' WHEN CAST(replace(file, '.jpg', '') AS BIGINT) % 2 = 0 THEN 'broken at source' ELSE 'not crawled' END AS status, count(*) AS n FROM j GROUP BY 1, 2")
def asset_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.replace("file", F.lit(".jpg"), F.lit("")).cast("long")
    j = jobs(spark, sf_dir)
    present = j.where(number % 7 != 0).select(F.col("file").alias("f1"))
    broken = j.where(number % 2 == 0).select(F.col("file").alias("f2"))
    s = j.join(present, F.col("file") == F.col("f1"), "left").join(broken, F.col("file") == F.col("f2"), "left")
    return s.groupBy("dest", F.when(F.col("f1").isNotNull(), "present").when(F.col("f2").isNotNull(), "broken at source").otherwise("not crawled").alias("status")).agg(F.count("*").alias("n"))
