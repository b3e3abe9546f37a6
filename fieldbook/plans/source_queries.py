"""Scans and sinks: tables are written to a shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.plans.registry import query
from fieldbook.plans.scratch import scratch
from fieldbook.sources import records as S
from fieldbook.sources.tables import table

_DOC = "doc_id long, lang string, n_chars long"


@query("scan_collection", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE n_chars END AS n_chars, doc_id % 10 = 0 AS broken FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS doc_id_, * FROM documents) WHERE doc_id % 10 <> 0 UNION ALL SELECT NULL, NULL, NULL, true FROM documents WHERE doc_id % 10 = 0")
def scan_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, each tenth broken off."""
    path = scratch(spark, "collection")
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value"))
    d.select(F.when(F.col("doc_id") % 10 == 0, F.substring("value", 1, 12)).otherwise(F.col("value")).alias("value")).write.text(path)
    r = S.scan_collection(spark, path, _DOC)
    broken = F.col("parse_error").isNotNull()
    return r.select(F.when(~broken, F.col("doc_id")).alias("doc_id"), F.when(~broken, F.col("lang")).alias("lang"), F.when(~broken, F.col("n_chars")).alias("n_chars"), broken.alias("broken"))


@query("scan_manifest_latest", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events WHERE event_id % 13 <> 0 GROUP BY user_id")
def scan_manifest_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of JSON lines with blank and malformed ones; the last line of each user wins."""
    path = scratch(spark, "manifest")
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    e.select(F.when(F.col("event_id") % 26 == 0, F.lit("")).when(F.col("event_id") % 13 == 0, F.lit("{nonsense")).otherwise(F.col("value")).alias("value")).write.text(path)
    log = S.manifest_rows(spark.read.text(path), "event_id long, user_id long, event_type string")
    return S.latest(log, "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("append_manifest", "SELECT page_id AS seq, url, sha256(html) AS sha256, strlen(html) AS content_length, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS http_status FROM pages")
def append_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "log")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("content_length"), F.when(F.col("page_id") % 17 == 0, 404).otherwise(200).alias("http_status"))
    S.append_manifest(rows.where("seq % 2 = 0"), path)
    S.append_manifest(rows.where("seq % 2 = 1"), path)
    return spark.read.schema("seq long, url string, sha256 string, content_length long, http_status int").json(path)


@query("archive_date", "SELECT CAST(CAST(arg_min(ts, event_id) FILTER (WHERE event_id >= 100) AS DATE) AS VARCHAR) AS archived FROM events")
def archive_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") >= 100, F.col("ts")).alias("ts"))
    return S.archive_date(e, "ts", "event_id")


@query("scan_checklist_csv", "SELECT p_name AS common, p_type AS scientific, CAST(p_partkey AS VARCHAR) AS code, p_size AS sort, CASE p_partkey % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'other' ELSE 'species' END AS category FROM part WHERE p_partkey % 6 <> 0")
def scan_checklist_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "checklist")
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "issf").when(F.col("p_partkey") % 4 == 1, "hybrid").otherwise("species")
    rows = p.select(F.col("p_type").alias("﻿SCIENTIFIC_NAME"), F.when(F.col("p_partkey") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("COMMON_NAME"), F.col("p_partkey").cast("string").alias("SPECIES_CODE"), kind.alias("CATEGORY"), F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("TAXON_ORDER"), F.lit("").alias("REPORT_AS"))
    rows.write.option("header", True).csv(path)
    return S.scan_checklist_csv(spark, path).select("common", "scientific", "code", "sort", "category")


@query("decode_pages", "SELECT doc_id, translate(regexp_replace(text, '[^\\x00-\\x{FF}]', '', 'g'), chr(146) || chr(160), '’ ') AS text FROM documents")
def decode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as ISO-8859-1 bytes and back."""
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", ""), "ISO-8859-1")
    return S.decode_pages(table(spark, sf_dir, "documents").select("doc_id", latin.alias("content"))).select("doc_id", "text")


@query("write_records", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    S.write_records(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey"), ["o_orderkey", "o_custkey"], path, "o_orderstatus")
    return spark.read.parquet(path)


@query("changed_records", "SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'added' WHEN doc_id % 20 = 1 THEN 'removed' ELSE 'changed' END AS status FROM documents WHERE doc_id % 20 IN (0, 1) OR trim(text) <> text OR contains(text, '  ')")
def changed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against stored ones with blanks collapsed; some are missing on either side."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stored = d.where("doc_id % 20 <> 0").withColumn("text", F.regexp_replace(F.trim("text"), "  +", " "))
    return S.changed_records(d.where("doc_id % 20 <> 1"), stored, "doc_id")


@query("subset_by_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (4, 7, 1200)")
def subset_by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.subset_by_keys(table(spark, sf_dir, "orders"), "o_orderkey", "4, 7,1200").select("o_orderkey", "o_custkey")


@query("preserve_owned_fields", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer")
def preserve_owned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh customers in lower case; stored ones keep what they own unless it is blank or absent."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    fresh = c.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1)).withColumn("c_mktsegment", F.lower("c_mktsegment"))
    stored = c.where("c_custkey % 5 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    return S.preserve_owned_fields(fresh, stored, "c_custkey", ["c_mktsegment"])


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("extraction_counts", " UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in _TABLES))
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _TABLES:
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("collection"), "n")
        out = one if out is None else out.unionByName(one)
    return out
