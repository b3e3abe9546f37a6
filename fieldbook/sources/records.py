"""Record collections, logs and checklists: scans and keyed sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def scan_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a folder of JSON lines; one that does not parse is a row with parse_error, not a failure."""
    full = T._parse_datatype_string(f"{schema}, parse_error string")
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "parse_error").json(path).withColumn("file", F.regexp_replace("_metadata.file_name", r"\.[^.]+$", ""))


def manifest_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed lines (value) of a log; blank and malformed ones and those without a key go."""
    return lines.where("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; rows without a key go.  Partial aggregation keeps one row a key and task."""
    rest = [c for c in log.columns if c != key]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def archive_date(log: DataFrame, ts: str, seq: str) -> DataFrame:
    """One row: the date of the first row that has one, else 'unknown'."""
    day = F.to_date(F.col(ts))
    return log.agg(F.coalesce(F.min_by(day, F.when(day.isNotNull(), F.col(seq))).cast("string"), F.lit("unknown")).alias("archived"))


def scan_checklist_csv(spark: SparkSession, path: str) -> DataFrame:
    """A checklist with a header and perhaps a byte order mark: trimmed, empty is null, whole sort numbers, rows without a name dropped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    t = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = raw.select(t("SCIENTIFIC_NAME").alias("scientific"), t("COMMON_NAME").alias("common"), t("SPECIES_CODE").alias("code"), t("CATEGORY").alias("kind"), t("TAXON_ORDER").try_cast("double").cast("int").alias("sort"), t("REPORT_AS").alias("report_as"))
    return out.where("scientific IS NOT NULL AND common IS NOT NULL").withColumn("category", F.when(F.col("kind") == "species", "species").when(F.col("kind").isin("issf", "form", "intergrade"), "form").otherwise("other"))


#: C1 bytes and what they stand for in Windows-1252.
def decode_pages(raw: DataFrame, column: str = "content") -> DataFrame:
    """raw with its bytes read as ISO-8859-1 and repaired, as text."""
    from fieldbook.functions.text import repair_c1

    return raw.withColumn("text", repair_c1(F.decode(F.col(column), "ISO-8859-1")))


def ordered_columns(df: DataFrame, known: list[str]) -> DataFrame:
    """df with the known columns first, in their order, and all others after them."""
    return df.select(*[c for c in known if c in df.columns], *[c for c in df.columns if c not in known])


def write_records(df: DataFrame, known: list[str], path: str, collection: str | None = None) -> None:
    w = ordered_columns(df, known).write.mode("overwrite")
    (w.partitionBy(collection) if collection else w).parquet(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def changed_records(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, status) of records whose content differs: added, changed or removed."""
    rest = [c for c in fresh.columns if c != key]
    f = fresh.select(F.col(key).alias("_f"), F.struct(*rest).alias("fr"))
    s = stored.select(F.col(key).alias("_s"), F.struct(*rest).alias("sr"))
    j = f.join(s, F.col("_f") == F.col("_s"), "full").where(~F.col("fr").eqNullSafe(F.col("sr")))
    return j.select(F.coalesce("_f", "_s").alias(key), F.when(F.col("_s").isNull(), "added").when(F.col("_f").isNull(), "removed").otherwise("changed").alias("status"))


def subset_by_keys(df: DataFrame, key: str, only: str) -> DataFrame:
    """Rows of the listed keys (a,b,c); an empty list is everything."""
    wanted = [k.strip() for k in only.split(",") if k.strip()]
    return df.where(F.col(key).cast("string").isin(*wanted)) if wanted else df


def preserve_owned_fields(fresh: DataFrame, stored: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """fresh rows with the owned columns of stored ones where those are not null or blank."""
    s = stored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_s_{c}") for c in owned])
    kept = lambda c: F.when(F.col(f"_s_{c}").cast("string") != "", F.col(f"_s_{c}"))
    return fresh.join(s, F.col(key) == F.col("_k"), "left").select(*[F.coalesce(kept(c), F.col(c)).alias(c) if c in owned else F.col(c) for c in fresh.columns])


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
