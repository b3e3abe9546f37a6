"""Presence queries over line items as records: entity = brand, region = supplier's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators import presence as P
from fieldbook.plans.registry import query
from fieldbook.sources.tables import table


def records(spark: SparkSession, sf_dir: str, entity: str = "p_brand") -> DataFrame:
    """(entity, region, month) of returned line items; the dimensions are joined as Catalyst sees fit."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.month("l_shipdate").alias("month"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(entity).alias("entity"))
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("entity", "region", "month")


def cells(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    return P.cells(records(spark, sf_dir, "p_brand || '/' || p_type" if sparse else "p_brand"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), F.col("n_nationkey").alias("pos"))


def _cte(entity: str) -> str:
    return f"""cells AS (SELECT *, CASE code WHEN 'C' THEN 5 WHEN 'F' THEN 4 WHEN 'U' THEN 3 WHEN 'R' THEN 2 WHEN 'I' THEN 1 ELSE 0 END AS rank FROM (
  SELECT {entity} AS entity, n_name AS region, month(l_shipdate) AS month,
    CASE WHEN count(*) >= 5 THEN 'C' WHEN count(*) = 4 THEN 'F' WHEN count(*) = 3 THEN 'U' WHEN count(*) = 2 THEN 'R' ELSE 'I' END AS code
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_returnflag = 'R' GROUP BY 1, 2, 3)),
dense AS (SELECT e.entity, r.n_name AS region, r.n_nationkey AS pos, m.month, coalesce(c.code, '') AS code, coalesce(c.rank, 0) AS rank
  FROM (SELECT DISTINCT entity FROM cells) e CROSS JOIN nation r CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m
  LEFT JOIN cells c ON c.entity = e.entity AND c.region = r.n_name AND c.month = m.month)"""


PM = "WITH " + _cte("p_brand")
SPARSE = "WITH " + _cte("p_brand || '/' || p_type")
HOME, MONTH = "NATION_19", 8


@query("present_in", f"{PM} SELECT row_number() OVER (ORDER BY rank DESC, entity) AS position, entity, code, rank FROM cells WHERE region = '{HOME}' AND month = {MONTH} AND rank >= 1")
def present_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.present_in(cells(spark, sf_dir), HOME, MONTH, 1)


@query("present_tally", f"{PM} SELECT code, CASE code WHEN 'C' THEN 'Common' WHEN 'F' THEN 'Fairly common' WHEN 'U' THEN 'Uncommon' WHEN 'R' THEN 'Rare' ELSE 'Irregular' END AS label, rank, count(*) AS n FROM cells WHERE region = '{HOME}' AND month = {MONTH} AND rank >= 1 GROUP BY code, rank")
def present_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.present_tally(P.present_in(cells(spark, sf_dir), HOME, MONTH, 1))


@query("present_cube", f"{PM} SELECT region, month, rank AS min_rank, sum(count(*)) OVER (PARTITION BY region, month ORDER BY rank DESC) AS n FROM cells GROUP BY region, month, rank")
def present_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.present_cube(cells(spark, sf_dir))


@query("presence_long", f"{SPARSE} SELECT entity, region, month, code, rank FROM dense")
def presence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.presence_long(cells(spark, sf_dir, True), regions(spark, sf_dir))


@query("code_at", f"{PM}, q AS (SELECT DISTINCT s_suppkey, n_name AS region, 1 + s_suppkey % 14 AS month, 'Brand#' || (1 + s_suppkey % 30) AS entity FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT q.s_suppkey, q.entity, q.region, q.month, coalesce(c.code, '') AS code, coalesce(c.rank, 0) AS rank FROM q LEFT JOIN cells c ON c.entity = q.entity AND c.region = q.region AND c.month = q.month")
def code_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups, some of months and entities that do not exist: blank and rank 0."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    q = s.select("s_suppkey", F.col("n_name").alias("region"), (1 + F.col("s_suppkey") % 14).alias("month"), F.concat(F.lit("Brand#"), 1 + F.col("s_suppkey") % 30).alias("entity"))
    found = q.join(cells(spark, sf_dir), ["entity", "region", "month"], "left")
    return found.select("s_suppkey", "entity", "region", "month", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("rank", F.lit(0)).alias("rank"))


@query("recorded_anywhere", f"{SPARSE} SELECT DISTINCT p_brand || '/' || p_type AS entity, (p_brand || '/' || p_type) IN (SELECT entity FROM cells) AS recorded FROM part")
def recorded_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "part").select(F.expr("p_brand || '/' || p_type").alias("entity")).distinct()
    found = cells(spark, sf_dir, True).groupBy("entity").agg(F.bool_or(F.col("code") != "").alias("r"))
    return every.join(found, "entity", "left").select("entity", F.coalesce("r", F.lit(False)).alias("recorded"))


@query("regions_present", f"{SPARSE} SELECT entity, string_agg(region, ',' ORDER BY pos) AS regions, count(*) AS n FROM (SELECT DISTINCT entity, region, pos FROM dense WHERE code <> '') GROUP BY entity")
def regions_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cells(spark, sf_dir, True).where("code <> ''").join(regions(spark, sf_dir), "region")
    listed = placed.groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("pos", "region"))).alias("r"))
    return listed.select("entity", F.array_join("r.region", ",").alias("regions"), F.size("r").cast("long").alias("n"))


@query("peak_code", f"{PM} SELECT entity, region, max_by(code, rank) AS code, max(rank) AS rank FROM cells GROUP BY entity, region")
def peak_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.peak_code(cells(spark, sf_dir))


_RUNS = f"""{SPARSE}, pairs AS (SELECT entity, region, list(code ORDER BY month) AS codes FROM dense GROUP BY entity, region HAVING bool_or(code <> '')),
starts AS (SELECT entity, region, codes, unnest(CASE WHEN len(list_filter(codes, lambda c: c = '')) = 0 THEN [1] ELSE list_filter(range(1, 13), lambda i: codes[i] <> '' AND codes[(i + 10) % 12 + 1] = '') END) AS s FROM pairs),
runs AS (SELECT entity, region, s AS start_month, coalesce(list_min(list_filter(range(0, 12), lambda k: codes[(s - 1 + k) % 12 + 1] = '')), 12) AS months FROM starts)"""


@query("season_runs", f"{_RUNS} SELECT entity, region, start_month, (start_month + months - 2) % 12 + 1 AS end_month, months FROM runs")
def season_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.season_runs(P.year_codes(cells(spark, sf_dir, True)))


_M = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


@query("season_summary", f"{_RUNS} SELECT entity, region, string_agg(CASE WHEN months = 12 THEN 'Year-round' WHEN months = 1 THEN {_M}[start_month] ELSE {_M}[start_month] || '–' || {_M}[(start_month + months - 2) % 12 + 1] END, ', ' ORDER BY start_month) AS season FROM runs GROUP BY entity, region")
def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.season_summary(P.year_codes(cells(spark, sf_dir, True)))


@query("region_rollup", f"{PM} SELECT n_name AS region, (SELECT count(DISTINCT entity) FROM cells WHERE region = n_name) AS entities, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS sites FROM nation")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = cells(spark, sf_dir).groupBy("region").agg(F.count_distinct("entity").alias("e"))
    sites = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    both = regions(spark, sf_dir).join(entities, "region", "left").join(sites, F.col("pos") == F.col("s_nationkey"), "left")
    return both.select("region", F.coalesce("e", F.lit(0)).alias("entities"), F.coalesce("s", F.lit(0)).alias("sites"))


@query("common_in_region", f"{PM}, peak AS (SELECT entity, region, max(rank) AS r FROM cells GROUP BY entity, region) SELECT region, entity, count(*) OVER (PARTITION BY region) AS n FROM peak WHERE r = 5")
def common_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    return P.peak_code(cells(spark, sf_dir)).where("code = 'C'").select("region", "entity", F.count("*").over(W.partitionBy("region")).alias("n"))


@query("month_presence", f"{PM} SELECT region, pos, CASE code WHEN 'C' THEN 'Common' WHEN 'F' THEN 'Fairly common' WHEN 'U' THEN 'Uncommon' WHEN 'R' THEN 'Rare' ELSE 'Irregular' END AS label FROM dense WHERE entity = 'Brand#1' AND month = 3 AND code <> ''")
def month_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir).where("entity = 'Brand#1' AND month = 3 AND code <> ''").join(regions(spark, sf_dir), "region")
    return found.select("region", "pos", P.label_of(F.col("code")).alias("label"))


@query("home_suggestions", f"{PM} SELECT entity FROM cells WHERE region = '{HOME}' AND month = {MONTH} AND code = 'C' AND entity IN (SELECT p_brand FROM part WHERE p_size <= 10) ORDER BY entity LIMIT 24")
def home_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 24 by name of what is common at home this month and has an image (here: a part of size ten at most)."""
    imaged = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_brand").alias("entity"))
    return cells(spark, sf_dir).where((F.col("region") == HOME) & (F.col("month") == MONTH) & (F.col("code") == "C")).join(imaged, "entity", "left_semi").select("entity").orderBy("entity").limit(24)


@query("presence_grid", f"{SPARSE} SELECT entity, region, {', '.join(f'max(CASE WHEN month = {m} THEN code END) AS m{m}' for m in range(1, 13))}, bool_or(code <> '') AS shown FROM dense GROUP BY entity, region")
def presence_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = P.presence_long(cells(spark, sf_dir, True), regions(spark, sf_dir))
    months = [F.max(F.when(F.col("month") == m, F.col("code"))).alias(f"m{m}") for m in range(1, 13)]
    return dense.groupBy("entity", "region").agg(*months, F.bool_or(F.col("code") != "").alias("shown"))


@query("compact_encode", f"{SPARSE} SELECT entity, region, string_agg(CASE WHEN code = '' THEN ' ' ELSE code END, '' ORDER BY month) AS codes FROM dense GROUP BY entity, region HAVING bool_or(code <> '')")
def compact_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compact_encode(P.year_codes(cells(spark, sf_dir, True)))


@query("compact_decode", f"{SPARSE} SELECT entity, region, month, code FROM dense WHERE (entity, region) IN (SELECT (entity, region) FROM cells)")
def compact_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compact_decode(P.compact_encode(P.year_codes(cells(spark, sf_dir, True))))


@query("paint_cells", f"{PM} SELECT entity, region, month, CASE WHEN region = '{HOME}' AND entity = 'Brand#3' THEN 'C' WHEN region = '{HOME}' AND month = 2 THEN '' ELSE code END AS code FROM dense")
def paint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row filled with C, and one month of a region cleared for the rest."""
    dense = P.presence_long(cells(spark, sf_dir), regions(spark, sf_dir))
    row = dense.where((F.col("region") == HOME) & (F.col("entity") == "Brand#3")).select("entity", "region", "month", F.lit("C").alias("code"))
    column = dense.where((F.col("region") == HOME) & (F.col("entity") != "Brand#3") & (F.col("month") == 2)).select("entity", "region", "month", F.lit("").alias("code"))
    return P.paint_cells(dense, row.unionByName(column))


@query("parse_state", "SELECT page_id, CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) IN ('x', 'y') THEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) ELSE '' END AS region, coalesce(CASE WHEN try_cast(regexp_extract(url, '[?&]page=([0-9]{1,9})(?:[&#]|$)', 1) AS INT) BETWEEN 1 AND 12 THEN try_cast(regexp_extract(url, '[?&]page=([0-9]{1,9})(?:[&#]|$)', 1) AS INT) - 1 END, 0) AS month0, coalesce(CASE WHEN try_cast(regexp_extract(url, '[?&]min=([0-9]{1,9})(?:[&#]|$)', 1) AS INT) BETWEEN 1 AND 5 THEN try_cast(regexp_extract(url, '[?&]min=([0-9]{1,9})(?:[&#]|$)', 1) AS INT) END, 1) AS min_rank FROM pages")
def parse_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.try_parse_url(F.col("url"), F.lit("QUERY"), F.lit("ref"))
    region, month, rank = P.parse_state(F.col("url"), F.coalesce(ref.isin("x", "y"), F.lit(False)), ("ref", "page", "min"))
    return table(spark, sf_dir, "pages").select("page_id", region.alias("region"), month.alias("month0"), rank.alias("min_rank"))


@query("build_state_query", f"{PM} SELECT entity, region, month, 'region=' || region || '&month=' || month || CASE WHEN rank > 1 THEN '&min=' || rank ELSE '' END AS q FROM cells")
def build_state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("entity", "region", "month", P.build_state_query(F.col("region"), F.col("month") - 1, F.col("rank")).alias("q"))
