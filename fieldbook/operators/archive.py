"""Links, archives and integrity of crawled pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.sources.shared import ready_checkpoints

_NO_LINK = r"(?i)^(?:mailto:|javascript:|data:|#|tel:)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body has it; filters that move below a step stay short."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Site:
    """What an archive covers: hosts by a pattern, all of them one origin, paths below one root segment, and patterns of kinds.

    Patterns of kinds match the canonical path; vendor maps links as written to files that are kept beside the archive.
    """

    origin: str
    hosts: str
    root: str
    pages: tuple[str, ...]
    assets: tuple[str, ...]
    vendor: tuple[tuple[str, str], ...] = ()

    def canonical(self, url: Column) -> Column:
        return canonical_url(url, self.hosts, origin=self.origin, root=self.root)

    def kind(self, url: Column) -> Column:
        return url_kind(url, self.pages, self.assets)

    def path(self, url: Column) -> Column:
        """The stored path of a canonical URL, below the root."""
        return archive_path(F.replace(url, F.lit(self.origin + self.root), F.lit(self.origin + "/")), F.coalesce(self.kind(url), F.lit("")))


#: URLs anywhere in a text, their slashes escaped or not.
IN_TEXT = r"https?:\\?/\\?/[A-Za-z0-9_.-]+(?:\\?/[^\s\"'\\<>()/]*)+"


def canonical_url(
    url: Column, hosts: str, keep_query: tuple[str, ...] = (".ico", ".css"), reject: str = r"(?i)/searchresults$", origin: str | None = None, root: str | None = None
) -> Column:
    """The archive form of a URL, or null: scope by host suffix (a pattern), decoded path, query dropped but for some extensions.

    Hosts have one case; with an origin, all hosts in scope (and none at all) become it.  With a root (such as
    '/wiki/') only paths below it are in scope, and that segment has one case; the rest of a path keeps its own.
    """

    def form(u: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)), ":(?:80|443)$", "")
        out = u.rlike(_NO_LINK) | u.startswith("//") | (u.rlike("^[A-Za-z]+://") & ~host.rlike(hosts))
        if origin is None:
            out, start = out | ~u.rlike("^[A-Za-z]+://"), F.concat(F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1)), F.lit("://"), host)
        else:
            start = F.lit(origin)

        def with_path(path: Column) -> Column:
            decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
            query = lambda p: F.when(F.lower(p).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in keep_query) + ")$"), F.regexp_extract(u, r"(\?[^#]*)", 1)).otherwise(F.lit(""))
            return bound(decoded, lambda p: F.when((p != "") & ~p.rlike(reject), F.concat(start, p, query(p))))

        path = F.regexp_extract(u, r"^(?:[A-Za-z]+://[^/?#]*)?(/[^?#]*)", 1)
        if root is not None:
            name = re.escape(root.strip("/"))
            path = bound(path, lambda p: F.when(p.rlike(f"(?i)^/{name}(?:/|$)"), F.concat(F.lit(root), F.regexp_replace(p, f"(?i)^/{name}/?", ""))).otherwise(""))
        return F.when(~out, bound(path, with_path))

    return bound(F.trim(url), form)


def url_kind(url: Column, pages: tuple[str, ...], assets: tuple[str, ...]) -> Column:
    """page, asset or null, by the first list with a pattern that the path matches."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path.rlike("|".join(f"(?:{p})" for p in pages)), "page").when(path.rlike("|".join(f"(?:{p})" for p in assets)), "asset")


def archive_path(url: Column, kind: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^/", "")
    return F.when(path == "", F.lit("pages/index.html")).when(kind == "asset", F.concat(F.lit("assets/"), path)).otherwise(F.concat(F.lit("pages/"), path, F.lit(".html")))


def variant_siblings(name: Column) -> Column:
    """Other renditions of stem_[stl].ext and the original without suffix; none for other names."""
    part = lambda k: F.regexp_extract(name, r"(?i)^(.+)_([stl])\.(jpg|jpeg|gif|png)$", k)

    def others(p: Column) -> Column:
        made = [F.when(p["own"] != v, F.concat(p["stem"], F.lit(f"_{v}."), p["ext"])) for v in ("s", "t", "l")]
        return F.when(p["own"] != "", F.array_compact(F.array(*made, F.concat(p["stem"], F.lit("."), p["ext"])))).otherwise(F.array().cast("array<string>"))

    return bound(F.struct(part(1).alias("stem"), F.lower(part(2)).alias("own"), part(3).alias("ext")), others)


def resolve(base: Column, link: Column) -> Column:
    """A link of a page as an absolute URL."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*((?:/[^/?#]*)*/)", 1)
    return bound(F.replace(F.trim(link), F.lit("&amp;"), F.lit("&")), lambda link: (
        F.when(link.rlike(_NO_LINK), None).when(link.rlike("^[A-Za-z]+://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    ))


def without_dots(url: Column) -> Column:
    """A URL with the segments '.' and '..' of its path taken out."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(part)))

    def short(u: Column) -> Column:
        path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
        parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
        return F.concat(F.regexp_extract(u, r"^([A-Za-z]+://[^/?#]*)", 1), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), F.regexp_extract(u, r"^[^?#]*(.*)$", 1))

    return bound(url, lambda u: F.when(u.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), short(u)).otherwise(u))


#: Links of attributes: what stands before, the link, the quote behind it.
ATTRIBUTE = r"""(?i)((?:href|src|data-large_file|data-image_url)\s*=\s*["'])([^"']+)(["'])"""
_IN_STYLE = r"""(?i)url\(\s*["']?([^"')]+?)["']?\s*\)"""
_STYLES = r"""(?is)<style\b[^>]*>(.*?)</style>"""
_STYLE_ATTRIBUTE = r"""(?is)<[a-z][^<>]*\sstyle\s*=\s*(?:"([^"]*)"|'([^']*)')"""


def raw_links(html: Column, url: Column, site: Site) -> Column:
    """Links of a page as they are written: attributes, then url(...) of styles (all of it in a style sheet or a script), then URLs anywhere, as in scripts."""
    sheet = F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)).rlike(r"\.(?:css|js)$")
    styles = F.concat(F.regexp_extract_all(html, F.lit(_STYLES), F.lit(1)), F.regexp_extract_all(html, F.lit(_STYLE_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(html, F.lit(_STYLE_ATTRIBUTE), F.lit(2)))
    style = F.when(sheet, html).otherwise(F.array_join(styles, "\n"))
    own = F.transform(F.regexp_extract_all(html, F.lit(IN_TEXT), F.lit(0)), lambda x: F.replace(x, F.lit("\\/"), F.lit("/")))
    return F.concat(F.regexp_extract_all(html, F.lit(ATTRIBUTE), F.lit(2)), F.regexp_extract_all(style, F.lit(_IN_STYLE), F.lit(1)), own)


def canonical_links(rows: DataFrame, base: str, link: str, site: Site) -> DataFrame:
    """rows with dst, the canonical form of a link on a page; a step at a time, so that no step is written out within the next."""
    rows = rows.withColumn("_a", resolve(F.col(base), F.col(link)))
    rows = rows.withColumn("_b", without_dots(F.col("_a")))
    return rows.withColumn("dst", site.canonical(F.col("_b"))).drop("_a", "_b")


def extract_links(pages: DataFrame, site: Site) -> DataFrame:
    """(page_id, pos, src, dst) of the links within the site, in canonical form and of a kind that is archived.

    pages has page_id, url and html.  A link's place counts all that the page has; it is exploded before anything else is done to it.
    """
    each = pages.select("page_id", F.col("url").alias("src"), F.posexplode(raw_links(F.col("html"), F.col("url"), site)).alias("pos", "link"))
    found = canonical_links(each, "src", "link", site).select("page_id", "pos", "src", "dst")
    return found.where(site.kind(F.col("dst")).isNotNull())


def rewrite_links(pages: DataFrame, site: Site, index: DataFrame) -> DataFrame:
    """(page_id, path, html, replaced): pages with their links as paths from the page's own stored path.

    index has url (canonical) and path, of all that is archived.  A page is cut at its links; these meet the
    index, and the page is put together again.  Links of other sites, or to what is not in the index, stay as they
    are; those of vendored files point to them.  In scripts the site's own URLs are replaced, escaped or not.
    """
    cut = f"{ATTRIBUTE}|{IN_TEXT}"
    page = pages.select("page_id", "url", "html", site.canonical(F.col("url")).alias("_c"))
    page = page.where(site.kind(F.col("_c")).isNotNull()).select("page_id", "url", "html", site.path(F.col("_c")).alias("path"))
    parts = page.select("page_id", "url", "path", F.posexplode(F.regexp_extract_all("html", F.lit(cut), F.lit(0))).alias("pos", "whole"))
    parts = parts.select("*", *[F.regexp_extract("whole", ATTRIBUTE, k).alias(n) for k, n in ((1, "before"), (2, "link"), (3, "after"))])
    link = F.when(F.col("link") != "", F.col("link")).otherwise(F.replace("whole", F.lit("\\/"), F.lit("/")))
    vendor = F.create_map(*[F.lit(v) for pair in site.vendor for v in pair]) if site.vendor else F.lit(None).cast("map<string,string>")
    parts = canonical_links(parts.withColumn("raw", link), "url", "raw", site).withColumn("kept", F.try_element_at(vendor, F.col("link")))
    known = index.select(F.col("url").alias("dst"), F.col("path").alias("to")).where("dst IS NOT NULL").groupBy("dst").agg(F.min("to").alias("to"))
    met = parts.join(known, "dst", "left")
    to = F.coalesce("kept", "to")
    text = F.when(to.isNotNull(), F.concat("before", relative_path(F.col("path"), to), "after")).otherwise(F.col("whole"))
    new = met.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("links"), F.count(to).alias("replaced"))  # links of one page
    rest = page.select("page_id", "path", F.split("html", cut, -1).alias("rest"))
    joined = F.zip_with("rest", F.transform(F.coalesce("links", F.array().cast("array<struct<pos:int,text:string>>")), lambda x: x["text"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return rest.join(new, "page_id", "left").select("page_id", "path", F.array_join(joined, "").alias("html"), F.coalesce("replaced", F.lit(0)).cast("long").alias("replaced"))


def crawl_frontier(links: DataFrame, log: DataFrame, site: Site) -> DataFrame:
    """(tier, url, referrer, page_id, pos) of what is to be fetched: linked, or another rendition of what is linked, and not fetched by the log's last row.

    links is from extract_links, log has url, status and seq; only the last row of a URL counts, and only 200 is
    fetched.  Tier 0 is pages, 1 assets.  The first link to a URL refers to it: by page_id, then pos.  Within a tier order by page_id and pos.
    """
    named = links.select("page_id", "pos", "src", "dst", F.regexp_extract("dst", r"^(.*/)[^/]*$", 1).alias("folder"), F.regexp_extract("dst", r"([^/]*)$", 1).alias("name"))
    others = named.withColumn("others", variant_siblings(F.col("name")))
    found = others.select("page_id", "pos", "src", F.posexplode(F.concat(F.array("dst"), F.transform("others", lambda x: F.concat("folder", x)))).alias("k", "url"))
    first = found.groupBy("url").agg(F.min_by(F.struct("src", "page_id", "pos"), F.struct("page_id", "pos", "k")).alias("f"))
    done = log.groupBy(F.col("url").alias("_u")).agg(F.max_by("status", "seq").alias("status")).where("status = 200")
    tier = F.when(site.kind(F.col("url")) == "page", 0).when(site.kind(F.col("url")) == "asset", 1)
    new = first.join(done, F.col("url") == F.col("_u"), "left_anti").select(tier.alias("tier"), "url", F.col("f.src").alias("referrer"), "f.page_id", "f.pos")
    return new.where("tier IS NOT NULL")


#: Rounds after which what is known is put together again.
COMPACT_AFTER = 8
#: A frontier of so few nodes that does not grow is followed over several hops in one round.
NARROW, AHEAD = 1000, 8


def reachable_set(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """(node, hops) of all that edges (src, dst) lead to from seed (node).

    Edges are dealt by their source once.  A round joins the frontier with them and drops what is known; where the
    frontier is narrow and does not grow, as along a chain, it takes AHEAD hops at once.  Checkpoints cut the
    lineage; every COMPACT_AFTER rounds all that is known is written anew, dealt by node, so a long chain does
    not end with a partition for each of its rounds.  The loop ends when a round finds nothing to follow.
    """
    spark = edges.sparkSession
    ready_checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select("src", "dst").distinct().repartition(parts, "src").checkpoint()
    known = seed.select("node").distinct().withColumn("hops", F.lit(0)).repartition(parts, "node").checkpoint()
    frontier, recent, hop, before, width = known, [], 0, 0, known.count()
    while width:
        ahead = AHEAD if width <= min(NARROW, before) else 1
        levels, at = [], frontier.select("node")
        for k in range(ahead):
            at = at.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
            levels.append(at.withColumn("hops", F.lit(hop + k + 1)))
        found = reduce(DataFrame.unionByName, levels)
        if ahead > 1:
            found = found.groupBy("node").agg(F.min("hops").alias("hops"))
        found = reduce(lambda t, r: t.join(r, "node", "left_anti"), [known, *recent], found).checkpoint()
        hop += ahead
        recent.append(found)
        frontier = found.where(F.col("hops") == hop)  # what is nearer was followed already
        before, width = width, frontier.count()
        if len(recent) == COMPACT_AFTER:
            known, recent = reduce(DataFrame.unionByName, recent, known).repartition(parts, "node").checkpoint(), []
    return reduce(DataFrame.unionByName, recent, known)


def verify_integrity(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict) of manifest (path, sha256, status) against files (path, content)."""
    have = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_h"))
    j = manifest.join(have, F.col("path") == F.col("_p"), "left")
    return j.select("path", F.when(F.col("status") != 200, "not fetched").when(F.col("_p").isNull(), "missing").when(F.col("_h") != F.col("sha256"), "mismatch").otherwise("ok").alias("verdict"))


def relative_path(source: Column, target: Column) -> Column:
    """target as seen from the folder of source; both are paths with the same root."""
    a, b = F.split(source, "/"), F.split(target, "/")
    na, nb = F.size(a) - 1, F.size(b) - 1
    same = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(na, nb)), lambda i: (i < na) & (i < nb) & (F.get(a, i) == F.get(b, i))), F.lit(False)).cast("int") - 1
    return F.concat(F.repeat(F.lit("../"), na - same), F.array_join(F.slice(b, same + 1, nb + 1 - same), "/"))


def best_rendition(names: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file): the original, else the large, the thumb, the small rendition that exists, without regard to case.

    A file is the original of its own name and a rendition of the name without its mark; the best of each original is
    chosen before names meet them, so a name is one row, dealt once.
    """
    stem = F.regexp_replace("name", r"(?i)_[stl](\.[a-z]+)$", "$1")
    marks = (r"(?is)^(.*)_([lts])(\.[^.]+)\z", r"(?is)^([^.]*|.*\.)_([lts])()\z")  # before the extension, or at the end where there is none
    rank = lambda p: F.array_position(F.array(*map(F.lit, "lts")), F.lower(F.regexp_extract("file", p, 2))).cast("int")
    key = lambda p: F.lower(F.regexp_replace("file", p, "$1$3"))
    own = F.struct(F.lower("file").alias("k"), F.lit(0).alias("pos"))
    of = F.array_compact(F.array(own, *[F.when(F.col("file").rlike(p), F.struct(key(p).alias("k"), rank(p).alias("pos"))) for p in marks]))
    have = files.where("file IS NOT NULL").select("file", F.explode(of).alias("o")).groupBy("o.k").agg(F.min(F.struct("o.pos", "file")).alias("best"))
    wanted = names.select("name", F.lower(stem).alias("k"))
    return wanted.join(have, "k", "left").select("k", "name", F.col("best.file").alias("file")).distinct().select("name", "file")
