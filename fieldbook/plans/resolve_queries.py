"""Entity resolution over parts: some stand for legacy accounts, the others for a checklist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import name_fold
from fieldbook.operators import resolve as R
from fieldbook.plans.registry import query
from fieldbook.plans.text_queries import sql_name_fold
from fieldbook.sources.tables import table

_COMMON, _SCIENTIFIC = "p_name || ' ' || p_brand", "p_type || ' ' || p_size || ' ' || p_brand"


def fold(x):
    return name_fold(x, keep_digits=True)


def sql_fold(x: str) -> str:
    return sql_name_fold(x, True)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 5 = 0 OR p_partkey % 25 = 1").selectExpr("p_partkey AS slug", f"{_COMMON} AS common", f"{_SCIENTIFIC} AS scientific")


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey AS code", f"{_COMMON} AS common", f"{_SCIENTIFIC} AS scientific", "CASE WHEN p_partkey % 5 IN (1, 2) THEN 'species' ELSE 'form' END AS category", "CASE WHEN p_partkey % 5 IN (3, 4) THEN p_partkey - p_partkey % 5 + 1 END AS report_as", "p_partkey AS sort", "p_partkey AS seq")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey AS slug", "CASE WHEN p_partkey % 100 = 0 THEN p_partkey + 1 END AS code", "p_name AS common", "p_type AS scientific", "p_partkey + 1 AS sort", "'decided by hand' AS note", "'earlier' AS why", "p_partkey + 2 AS suggestion")


_CTE = f"""WITH acc AS (SELECT *, {sql_fold('common')} AS ck, {sql_fold('scientific')} AS sk FROM (SELECT p_partkey AS slug, {_COMMON} AS common, {_SCIENTIFIC} AS scientific FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 25 = 1)),
chk AS (SELECT *, {sql_fold('common')} AS ck, {sql_fold('scientific')} AS sk FROM (SELECT p_partkey AS code, {_COMMON} AS common, {_SCIENTIFIC} AS scientific, p_partkey % 5 IN (1, 2) AS species, p_partkey - p_partkey % 5 + 1 AS report_as FROM part WHERE p_partkey % 5 <> 0)),
bc AS (SELECT ck, arg_min(code, code) AS code, arg_min(common, code) AS common, arg_min(scientific, code) AS scientific FROM chk WHERE species GROUP BY ck),
bs AS (SELECT sk, min(code) AS code, arg_min(common, code) AS common FROM chk WHERE species GROUP BY sk),
bf AS (SELECT sk, arg_min(report_as, code) AS report_as FROM chk WHERE NOT species GROUP BY sk),
ov AS (SELECT p_partkey AS slug, CASE WHEN p_partkey % 100 = 0 THEN p_partkey + 1 END AS code, p_name AS common, p_type AS scientific, p_partkey + 1 AS sort FROM part WHERE p_partkey % 50 = 0),
ladder AS (SELECT acc.slug, acc.common, CASE WHEN ov.code IS NOT NULL THEN 'override' WHEN bc.code = bs.code THEN 'both' WHEN bc.code IS NOT NULL THEN 'common' WHEN bs.code IS NOT NULL THEN 'split' WHEN par.code IS NOT NULL THEN 'lumped' ELSE 'unmatched' END AS outcome,
  coalesce(ov.code, bc.code) AS match_code, CASE WHEN ov.code IS NOT NULL THEN ov.common ELSE bc.common END AS match_common, CASE WHEN ov.code IS NOT NULL THEN ov.scientific ELSE bc.scientific END AS match_scientific,
  CASE WHEN ov.code IS NULL AND bc.code IS NULL THEN coalesce(bs.code, par.code) END AS suggestion,
  CASE WHEN ov.code IS NULL AND bc.code IS NULL THEN CASE WHEN bs.code IS NOT NULL THEN 'only the scientific name matches ' || bs.common WHEN par.code IS NOT NULL THEN 'now a form of ' || par.common ELSE 'no name matches' END END AS reason, ov.slug IS NOT NULL AS has_note
  FROM acc LEFT JOIN ov ON ov.slug = acc.slug LEFT JOIN bc ON bc.ck = acc.ck LEFT JOIN bs ON bs.sk = acc.sk LEFT JOIN bf ON bf.sk = acc.sk LEFT JOIN chk par ON par.code = bf.report_as AND par.species)"""


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match_ladder(accounts(spark, sf_dir), checklist(spark, sf_dir), overrides(spark, sf_dir), fold)


@query("checklist_index", f"{_CTE} SELECT ck AS key, code, common FROM bc")
def checklist_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.checklist_index(checklist(spark, sf_dir), fold)[0].select(F.col("c_key").alias("key"), "c.code", "c.common")


@query("form_parent", f"{_CTE} SELECT f.code, p.code AS parent_code, p.common AS parent_common FROM chk f LEFT JOIN chk p ON p.code = f.report_as AND p.species WHERE NOT f.species")
def form_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.form_parent(checklist(spark, sf_dir)).select("code", F.col("parent.code").alias("parent_code"), F.col("parent.common").alias("parent_common"))


@query("match_ladder", f"{_CTE} SELECT slug, outcome, match_code, suggestion, reason FROM ladder")
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladder(spark, sf_dir).select("slug", "outcome", F.col("match.code").alias("match_code"), "suggestion", "reason")


@query("resolved_layer", f"{_CTE} SELECT slug, match_code AS code, match_common AS current_common, match_scientific AS current_scientific, match_code AS sort, CASE WHEN {sql_fold('match_common')} <> {sql_fold('common')} AND match_code IS NOT NULL THEN common END AS historic_common, CASE WHEN has_note THEN 'decided by hand' WHEN match_code IS NOT NULL AND {sql_fold('match_common')} <> {sql_fold('common')} THEN 'formerly ' || common END AS note FROM ladder")
def resolved_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = R.resolved_layer(ladder(spark, sf_dir), fold)
    return layer.withColumn("historic_common", F.when(F.col("code").isNotNull(), F.col("historic_common")))


@query("match_outcome_tally", f"{_CTE} SELECT outcome, count(*) AS n, sum(CASE WHEN match_code IS NOT NULL AND {sql_fold('match_common')} <> {sql_fold('common')} THEN 1 ELSE 0 END) AS renamed FROM ladder GROUP BY outcome")
def match_outcome_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ladder(spark, sf_dir)  # noqa: E741
    return l.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("match.code").isNotNull() & (fold(F.col("match.common")) != fold(F.col("common")))).alias("renamed"))


@query("pending_review", f"{_CTE} SELECT slug, outcome, suggestion, reason FROM ladder WHERE outcome IN ('split', 'lumped', 'unmatched')")
def pending_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pending_review(ladder(spark, sf_dir))


@query("merge_override_stub", f"{_CTE}, p AS (SELECT * FROM ladder WHERE outcome IN ('split', 'lumped', 'unmatched')) SELECT coalesce(ov.slug, p.slug) AS slug, ov.code, CASE WHEN ov.code IS NOT NULL OR p.slug IS NULL THEN 'earlier' ELSE p.reason END AS why, CASE WHEN ov.code IS NOT NULL OR p.slug IS NULL THEN ov.slug + 2 ELSE p.suggestion END AS suggestion FROM p FULL JOIN ov ON ov.slug = p.slug")
def merge_override_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_override_stub(R.pending_review(ladder(spark, sf_dir)), overrides(spark, sf_dir))


@query("override_progress", "SELECT slug, CASE WHEN code IS NOT NULL THEN 'resolved' WHEN slug % 150 = 0 THEN 'open' ELSE 'suggested' END AS state, count(*) OVER () AS total, count(code) OVER () AS resolved FROM (SELECT p_partkey AS slug, CASE WHEN p_partkey % 100 = 0 THEN p_partkey + 1 END AS code FROM part WHERE p_partkey % 50 = 0)")
def override_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's state, and how many of all are resolved; every third has no suggestion."""
    return R.override_progress(overrides(spark, sf_dir).withColumn("suggestion", F.when(F.col("slug") % 150 != 0, F.col("suggestion"))))
