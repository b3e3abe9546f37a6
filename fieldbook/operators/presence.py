"""Seasonal presence: categorical codes by entity, region and month.

The long form is (entity, region, month 1..12, code, rank); the blank code means not recorded and is
data, never null.  Regions have a canonical order that is carried as a position.  Dense results cross
entities with the region and month dimensions, which are small and fixed, inside one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.operators.ranking import placed

#: Code, label, rank.
LEVELS = (("C", "Common", 5), ("F", "Fairly common", 4), ("U", "Uncommon", 3), ("R", "Rare", 2), ("I", "Irregular", 1), ("", "Not recorded", 0))
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def rank_of(code: Column) -> Column:
    out = F.lit(0)
    for c, _, r in LEVELS:
        out = F.when(code == c, r).otherwise(out)
    return out


def label_of(code: Column) -> Column:
    out = F.lit("Not recorded")
    for c, label, _ in LEVELS:
        out = F.when(code == c, F.lit(label)).otherwise(out)
    return out


def code_of_count(n: Column) -> Column:
    """Code of a count of records: five or more are common, none is blank."""
    out = F.lit("")
    for c, _, r in LEVELS[1:-1]:
        out = F.when(n == r, F.lit(c)).otherwise(out)
    return F.when(n >= 5, F.lit("C")).otherwise(out)


def month_name(m: Column) -> Column:
    return F.get(F.array(*map(F.lit, MONTHS)), m - 1)


def cells(records: DataFrame) -> DataFrame:
    """(entity, region, month, code, rank) of the recorded cells from (entity, region, month)."""
    counted = records.groupBy("entity", "region", "month").agg(F.count("*").alias("n"))
    return counted.select("entity", "region", "month", code_of_count(F.col("n")).alias("code")).withColumn("rank", rank_of(F.col("code")))


def year_codes(recorded: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """(entity, region, codes): arrays of twelve codes of the pairs that have a recorded cell."""
    by_month = F.map_from_entries(F.collect_list(F.struct("month", "code")))
    return recorded.groupBy("entity", "region").agg(by_month.alias("m")).select("entity", "region", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("codes"))


def presence_long(recorded: DataFrame, regions: DataFrame) -> DataFrame:
    """Dense cells of every entity; regions is the dimension (region, pos)."""
    from pyspark.sql.functions import broadcast

    grid = recorded.select("entity").distinct().crossJoin(broadcast(regions.select("region"))).select("entity", "region", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    full = grid.join(recorded.select("entity", "region", "month", "code"), ["entity", "region", "month"], "left")
    return full.select("entity", "region", "month", F.coalesce("code", F.lit("")).alias("code")).withColumn("rank", rank_of(F.col("code")))


def present_in(recorded: DataFrame, region: str, month: int, min_rank: int = 1) -> DataFrame:
    """(position, entity, code, rank): what is at least so common there and then, commonest first, then by name."""
    found = recorded.where((F.col("region") == region) & (F.col("month") == month) & (F.col("rank") >= min_rank)).select("entity", "code", "rank")
    return placed(found, [F.col("rank").desc(), F.col("entity").asc()], out="position").select("position", "entity", "code", "rank")


def present_tally(found: DataFrame) -> DataFrame:
    """(code, label, n) of a result, scale order by rank; codes that do not occur are left out."""
    return found.groupBy("code").agg(F.count("*").alias("n")).select("code", label_of(F.col("code")).alias("label"), rank_of(F.col("code")).alias("rank"), "n")


def present_cube(recorded: DataFrame) -> DataFrame:
    """(region, month, min_rank, n): answers for every region, month and least rank that occurs."""
    counted = recorded.where("rank > 0").groupBy("region", "month", "rank").agg(F.count("*").alias("c"))
    above = W.partitionBy("region", "month").orderBy(F.col("rank").desc())
    return counted.select("region", "month", F.col("rank").alias("min_rank"), F.sum("c").over(above).alias("n"))


def peak_code(recorded: DataFrame) -> DataFrame:
    """(entity, region, code, rank): the best code over the year."""
    return recorded.groupBy("entity", "region").agg(F.max_by("code", "rank").alias("code"), F.max("rank").alias("rank"))


def runs_of(codes: Column) -> Column:
    """array<struct<s, n>> of the runs of present months (s from 0) by their start, closed over the year's end.

    A run starts where a month is present and the one before it, around the year, is not; all twelve are one run.
    """
    here = lambda i: F.get(codes, i % 12) != ""
    starts = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: here(i) & ~here(i + 11))
    length = lambda s: F.array_position(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: here(s + k)), False).cast("int")
    some = F.transform(starts, lambda s: F.struct(s.alias("s"), length(s).alias("n")))
    return F.when(F.forall(codes, lambda c: c != ""), F.array(F.struct(F.lit(0).alias("s"), F.lit(12).alias("n")))).otherwise(some)


def season_runs(years: DataFrame) -> DataFrame:
    """(entity, region, start_month, end_month, months): runs of present months."""
    run = years.select("entity", "region", F.inline(runs_of(F.col("codes"))))
    return run.select("entity", "region", (F.col("s") + 1).alias("start_month"), ((F.col("s") + F.col("n") - 1) % 12 + 1).alias("end_month"), F.col("n").alias("months"))


def season_summary(years: DataFrame) -> DataFrame:
    """(entity, region, season): 'Not recorded', 'Year-round' or runs such as 'Apr–May, Nov–Feb' by their start."""
    month = lambda i: month_name(i % 12 + 1)
    text = lambda r: F.when(r["n"] == 12, F.lit("Year-round")).when(r["n"] == 1, month(r["s"])).otherwise(F.concat(month(r["s"]), F.lit("–"), month(r["s"] + r["n"] - 1)))
    season = F.array_join(F.transform(runs_of(F.col("codes")), text), ", ")
    return years.select("entity", "region", F.when(season == "", F.lit("Not recorded")).otherwise(season).alias("season"))


def compact_encode(years: DataFrame) -> DataFrame:
    """(entity, region, codes): twelve characters, blank as a space."""
    return years.select("entity", "region", F.array_join(F.transform("codes", lambda c: F.when(c == "", F.lit(" ")).otherwise(c)), "").alias("codes"))


def compact_decode(strings: DataFrame) -> DataFrame:
    """(entity, region, month, code) from strings of twelve characters; a short one reads as blank."""
    long = strings.select("entity", "region", "codes", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return long.select("entity", "region", "month", F.trim(F.substring(F.col("codes"), F.col("month"), F.lit(1))).alias("code"))


def paint_cells(dense: DataFrame, edits: DataFrame) -> DataFrame:
    """dense cells with the codes of edits (entity, region, month, code) in place; others stay."""
    new = edits.select("entity", "region", "month", F.col("code").alias("new"))
    painted = dense.join(new, ["entity", "region", "month"], "left")
    return painted.select("entity", "region", "month", F.coalesce("new", "code").alias("code"))


def integer_in(text: Column, low: int, high: int) -> Column:
    """The integer that a text of digits is, if it lies within the bounds, else null."""
    value = F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text).try_cast("int"))
    return F.when(value.between(low, high), value)


def parse_state(url: Column, region_ok: Column, keys: tuple[str, str, str] = ("region", "month", "min"), default_region: str = "", default_month: int = 0, default_rank: int = 1) -> tuple[Column, Column, Column]:
    """(region, month from 0, least rank) of a URL's query; each falls back for itself."""
    part = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k))
    region = F.when(region_ok, part(keys[0])).otherwise(F.lit(default_region))
    return region, F.coalesce(integer_in(part(keys[1]), 1, 12) - 1, F.lit(default_month)), F.coalesce(integer_in(part(keys[2]), 1, 5), F.lit(default_rank))


def build_state_query(region: Column, month0: Column, min_rank: Column) -> Column:
    return F.concat_ws("&", F.concat(F.lit("region="), region), F.concat(F.lit("month="), month0 + 1), F.when(min_rank > 1, F.concat(F.lit("min="), min_rank)))
