"""Catalogue listings, search and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.operators.ranking import first_k, placed
from fieldbook.sources.shared import ready_checkpoints


def display_names(published: Column, current: Column, historic: Column, show_historic: Column) -> tuple[Column, Column]:
    """(shown name, historic name where it is different and not shown already)."""
    given = lambda c: F.nullif(c, F.lit(""))
    shown = F.coalesce(F.when(show_historic, given(historic)), given(current), published)
    return shown, F.when(given(historic).isNotNull() & (historic != shown), historic)


def listing_order(key: str, group: str, name: str) -> list[Column]:
    """By key (nulls last), then group, then name."""
    return [F.col(key).asc_nulls_last(), F.lower(F.col(group)), F.col(group), F.lower(F.col(name)), F.col(name)]


def ranked(rows: DataFrame, key: str, group: str, name: str, out: str = "place", within: list[str] | None = None) -> DataFrame:
    """rows with their place by key (nulls last), then group, then name, over all or within each of some groups."""
    return placed(rows, listing_order(key, group, name), within, out)


def siblings(members: DataFrame, family: str, member: str, name: str, order: list[Column], k: int) -> DataFrame:
    """(member, sibling, nth, total): the first k others of each member's family by an order, and how many there are.

    The first k + 1 of a family serve all of its members; they alone are placed.
    """
    lead = first_k(members, order, [family], k + 1, "_p").select(F.col(family).alias("_f"), F.col(member).alias("_m"), F.col(name).alias("sibling"), "_p")
    totals = members.groupBy(F.col(family).alias("_g")).agg((F.count("*") - 1).alias("total"))
    own = lead.select(F.col("_m").alias("_own"), F.col("_p").alias("_at"))
    each = members.select(family, member).join(totals, F.col(family).eqNullSafe(F.col("_g"))).join(own, F.col(member) == F.col("_own"), "left")
    pairs = each.join(lead, F.col(family).eqNullSafe(F.col("_f")) & (F.col(member) != F.col("_m")))
    nth = F.col("_p") - F.when(F.col("_at") < F.col("_p"), 1).otherwise(0)
    return pairs.select(member, "sibling", nth.alias("nth"), "total").where(F.col("nth") <= k)


def search_aliases(*names: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(n), F.lit("")) for n in names])))


def search_index(*collections: DataFrame) -> DataFrame:
    """Union of (href, kind, name, sub, grp, aliases)."""
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c)
    return out


#: Fields and their weights.
FIELDS = (("name", 1.0), ("aliases", 0.7), ("sub", 0.5), ("grp", 0.25))


def trigrams(x: Column) -> Column:
    return F.when(F.length(x) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3))))).otherwise(F.array(x))


def fuzzy_search(index: DataFrame, queries: DataFrame, k: int = 8, cut_off: float = 0.35, least: int = 2) -> DataFrame:
    """(q, place, href, score): the best k of each query; index has href and the text columns of FIELDS.

    Candidates are tokens that share a trigram with the query, or start as it does; a token scores
    1 - distance / length of the query, 1 where it holds the query.  The best field counts, by weight.
    Of the tokens that meet, those whose length alone puts them too far off, and that do not hold the query, go before
    pairs are told apart and distances are measured, which stop at the farthest that counts.
    """
    q = queries.where(F.length("q") >= least).select("q", F.lower("q").alias("ql")).distinct()
    q = q.select("q", "ql", F.explode(F.array_union(trigrams(F.col("ql")), F.array(F.substring("ql", 1, 2)))).alias("gram"))
    fields = F.array(*[F.struct(F.coalesce(F.lower(F.col(f)), F.lit("")).alias("text"), F.lit(w).alias("weight")) for f, w in FIELDS if f in index.columns])
    t = index.select("href", F.explode(fields).alias("f")).select("href", "f.weight", F.explode(F.array_distinct(F.split("f.text", "[^a-z0-9#]+"))).alias("token")).where("token <> ''")
    words = t.select("token").distinct().select("token", F.explode(F.array_union(trigrams(F.col("token")), F.array(F.substring("token", 1, 2)))).alias("gram"))
    farthest = F.floor(F.length("ql") * cut_off + 1e-9).cast("int")
    holds = F.contains("token", "ql")
    fits = holds | (F.abs(F.length("token") - F.length("ql")) <= farthest)
    near = words.join(q, "gram").where(fits).select("q", "ql", "token").distinct()
    distance = F.expr(f"levenshtein(token, ql, CAST(floor(length(ql) * {cut_off} + 1e-9) AS INT))")  # -1 beyond that
    miss = F.when(holds, F.lit(0.0)).when(distance >= 0, distance / F.length("ql"))
    near = near.withColumn("miss", miss).where(F.col("miss") <= cut_off)
    best = near.join(t, "token").groupBy("q", "href").agg(F.round(F.max(F.col("weight") * (1 - F.col("miss"))), 6).alias("score"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "href"))).where(F.col("place") <= k)


def text_filter(q: str, *fields: str) -> Column:
    """Whether any field holds q in either case; a blank q passes everything."""
    if not q.strip():
        return F.lit(True)
    out = F.lit(False)
    for f in fields:
        out = out | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(q.strip().lower()))
    return out


def connected_names(groups: DataFrame) -> DataFrame:
    """(name, cluster) from (name, key): names that share a key, directly or over others, get the least name.

    Each key ties its names to its least one.  Rounds then contract these ties to stars: the larger
    neighbours of a node move to the least around it, then its smaller ones do; the number of rounds
    grows with the logarithm of the names in a chain.  Checkpoints cut the rounds.
    """
    ready_checkpoints(groups.sparkSession)
    pairs = groups.select("name", "key").distinct()
    hub = pairs.groupBy("key").agg(F.min("name").alias("m"))
    both = lambda t: t.select("a", "b").unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ties = both(pairs.join(hub, "key").select(F.col("name").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct().checkpoint()
    while True:
        least = ties.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ties.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        twice = stars.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if twice.unionByName(stars.join(stars.select(F.col("b").alias("a")), "a", "left_semi").select("a")).isEmpty():
            break
        ties = both(stars)
    names = pairs.select("name").distinct()
    return names.join(stars.withColumnRenamed("a", "name"), "name", "left").select("name", F.coalesce("b", "name").alias("cluster"))


def suspected_variants(credits: DataFrame) -> DataFrame:
    """(cluster, name): groups of two and more names that agree but for case and marks, single letters, or share a URL."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9 ]", ""), " +", " "))
    short = F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), "(?<= )[a-z](?= )", ""), " +", " "))
    url = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("u:"), F.rtrim("url", F.lit("/"))))
    keys = credits.where("trim(name) <> ''").select("name", F.explode(F.array_compact(F.array(F.concat(F.lit("p:"), plain), F.concat(F.lit("s:"), short), url))).alias("key")).where("key NOT IN ('p:', 's:')").distinct()
    found = connected_names(keys)
    many = found.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return found.join(many, "cluster").select("cluster", "name")


def rename_credit(records: DataFrame, old: str, new: str, url: str | None = None, photos: str = "photos") -> DataFrame:
    """records with a credit renamed in place within their photos, and renamed, the number of photos it touched.

    photos is an array of structs with credit, a struct of name and url.  Names are compared trimmed; with a
    url, that is replaced too, and '' means none.  Nothing is exploded: a record stays one row, untouched photos
    and all other fields are as they were.
    """
    if not old.strip() or not new.strip():
        raise ValueError("both names are required")
    is_old = lambda x: F.coalesce(F.trim(x["credit"]["name"]) == old.strip(), F.lit(False))

    def changed(x: Column) -> Column:
        credit = x["credit"].withField("name", F.lit(new.strip()))
        if url is not None:
            credit = credit.withField("url", F.nullif(F.lit(url.strip()), F.lit("")).cast("string"))
        return F.when(is_old(x), x.withField("credit", credit)).otherwise(x)

    touched = F.coalesce(F.size(F.filter(photos, is_old)), F.lit(0)).cast("long")
    counted = records.withColumn("renamed", F.when(F.col(photos).isNotNull(), touched).otherwise(0))
    return counted.withColumn(photos, F.transform(photos, changed))


def rename_account(renamed: dict[str, DataFrame]) -> DataFrame:
    """(collection, records, photos): what a renaming touched in each collection."""
    out = None
    for name, t in renamed.items():
        one = t.agg(F.count_if(F.col("renamed") > 0).alias("records"), F.coalesce(F.sum("renamed"), F.lit(0)).alias("photos")).select(F.lit(name).alias("collection"), "records", "photos")
        out = one if out is None else out.unionByName(one)
    return out
