"""Quality gates and audits: rules in one pass over the records, exploded to (where, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(broken: Column, severity: str, message: str | Column) -> Column:
    """A message where the rule is broken, else null."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(broken, F.struct(F.lit(severity).alias("severity"), text.alias("message")))


def check(records: DataFrame, where: Column, rules: list[Column]) -> DataFrame:
    """(where, severity, message) of every broken rule."""
    found = records.select(where.alias("where"), F.explode(F.array_compact(F.array(*rules))).alias("r"))
    return found.select("where", "r.severity", "r.message")


def split_by(records: DataFrame, key: str, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) records; issues has the key."""
    bad = issues.select(key).distinct()
    return records.join(bad, key, "left_anti"), records.join(bad, key, "left_semi")


def missing_references(referenced: DataFrame, archived: DataFrame) -> DataFrame:
    """(name) of referenced and not archived, without regard to case."""
    have = archived.select(F.lower("name").alias("k")).distinct()
    return referenced.select("name").distinct().join(have, F.lower("name") == F.col("k"), "left_anti")


def error_digest(issues: DataFrame, n: int = 20) -> DataFrame:
    """(message, n): messages without their record prefix, most frequent first."""
    return issues.where("severity = 'error'").groupBy(F.regexp_replace("message", r"^[^ ]+: ", "").alias("message")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "message").limit(n)


def same_rows(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, verdict): ok, differs, missing (only in a) or extra (only in b); of two independent readings."""
    x = a.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_ia"))
    y = b.select(*key, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    j = x.join(y, key, "full")
    return j.select(*key, F.when(F.col("_ib").isNull(), "missing").when(F.col("_ia").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "ok").otherwise("differs").alias("verdict"))


#: What a declared field may say, besides fields (of a record) or items (of a list).
RULES = {"type", "required", "one_of", "pattern", "min", "max", "min_items", "max_items", "exactly_one", "fields", "items"}
_FOUND = "array<struct<path:string,message:string>>"


def declared_type(spec: dict) -> str:
    """The type that records are read with: every value that is no record or list as text, so that wrong kinds are seen and told."""
    if unknown := set(spec) - RULES:
        raise ValueError(f"no such rule: {sorted(unknown)}")
    if "fields" in spec:
        return "struct<" + ",".join(f"`{k}`:{declared_type(v)}" for k, v in spec["fields"].items()) + ">"
    return f"array<{declared_type(spec['items'])}>" if "items" in spec else "string"


def declared_issues(value: Column, spec: dict, path: Column | None = None) -> Column:
    """All that a value breaks of a declared schema, as (path, message) structs; a path has names and places from 0, joined by dots.

    A missing value and null are the same, and break only 'required'.  Nested records and lists
    are compiled into the one expression, so a record is looked at once.
    """
    none = F.array().cast(_FOUND)
    here = F.lit("") if path is None else path
    below = lambda name: name if path is None else F.concat(path, F.lit("."), name)
    say = lambda broken, message: F.when(broken, F.array(F.struct(here.alias("path"), F.lit(message).alias("message")))).otherwise(none)
    found = [say(value.isNull(), "required")] if spec.get("required") else []
    if "fields" in spec:
        inner = [declared_issues(value[k], s, below(F.lit(k))) for k, s in spec["fields"].items()]
        found.append(F.when(value.isNotNull(), F.concat(*inner)).otherwise(none))
    elif "items" in spec:
        n = F.size(value)
        found += [say(n < spec["min_items"], f"under {spec['min_items']} items")] if "min_items" in spec else []
        found += [say(n > spec["max_items"], f"over {spec['max_items']} items")] if "max_items" in spec else []
        if flag := spec.get("exactly_one"):
            found.append(say((n > 0) & (F.size(F.filter(value, lambda x: F.coalesce(x[flag] == "true", F.lit(False)))) != 1), f"{flag}: not exactly one"))
        each = F.transform(value, lambda x, i: declared_issues(x, spec["items"], below(i.cast("string"))))
        found.append(F.coalesce(F.flatten(each), none))
    else:
        number = value.try_cast("double")
        kind = spec.get("type", "string")
        wrong = {"string": F.lit(False), "number": number.isNull(), "boolean": ~value.isin("true", "false")}[kind]
        found += [say(value.isNotNull() & wrong, f"not a {kind}")] if kind != "string" else []
        found += [say(~value.isin(*map(str, spec["one_of"])), "not one of " + ", ".join(map(str, spec["one_of"])))] if "one_of" in spec else []
        found += [say(~value.rlike(spec["pattern"]), f"not like {spec['pattern']}")] if "pattern" in spec else []
        found += [say(number < spec["min"], f"under {spec['min']}")] if "min" in spec else []
        found += [say(number > spec["max"], f"over {spec['max']}")] if "max" in spec else []
    return F.concat(*found) if found else none


def validated(records: DataFrame, text: str, spec: dict) -> DataFrame:
    """records with issues, an array of (path, message), of their JSON text by a declared schema; what is no record at all says so."""
    if "fields" not in spec:
        raise ValueError("a record is declared by its fields")
    kind = declared_type(spec)[:-1] + ",`_corrupt`:string>"
    read = records.withColumn("_r", F.from_json(F.col(text), kind, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    said = F.array(F.struct(F.lit("").alias("path"), F.lit("no record").alias("message"))).cast(_FOUND)
    return read.withColumn("issues", F.when(bad, said).otherwise(declared_issues(F.col("_r"), spec))).drop("_r")


def told(checked: DataFrame, key: str) -> DataFrame:
    """(key, path, message) of every issue of validated() rows.

    A plain explode has Spark ask first whether a record has any issue, with all that reads and checks it written out anew.
    """
    return checked.select(key, F.explode_outer("issues").alias("_i")).where("_i IS NOT NULL").select(key, "_i.path", "_i.message")


def accepted(checked: DataFrame) -> DataFrame:
    """The rows of validated() without an issue; they and quarantined() are all rows, and neither looks a second time."""
    return checked.where("size(issues) = 0").drop("issues")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where("size(issues) > 0")


def audit_summary(asked: DataFrame, checks: DataFrame, fetches: DataFrame, key: str) -> DataFrame:
    """(key, checked, mismatches, verdict) of every key that was asked for, checked or not.

    checks has key and ok, a row for each field of an extracted record; fetches has key and status, null where nothing
    answered.  The verdict is 'missing' without a record, 'unreachable', 'HTTP n' for any status but 200, then 'differs' or 'ok'; what was not fetched well was not compared.
    """
    fields = checks.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad"))
    got = fetches.select(key, "status", F.lit(True).alias("tried"))
    j = asked.select(key).distinct().join(fields, key, "left").join(got, key, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("status").isNull(), "unreachable").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    compared = status.isNull()
    return j.select(
        key, F.when(compared, F.col("n")).otherwise(0).alias("checked"), F.when(compared, F.col("bad")).otherwise(0).alias("mismatches"), F.coalesce(status, F.when(F.col("bad") > 0, "differs").otherwise("ok")).alias("verdict")
    )
