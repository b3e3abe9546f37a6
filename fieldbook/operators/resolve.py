"""Conservative entity resolution against a checklist: accept only when the evidence agrees.

accounts: (slug, common, scientific).  checklist: (code, common, scientific, category, report_as, sort,
seq) with seq the order of the file; sub-forms have a category other than 'species' and report to a
species' code.  overrides: (slug, code, common, scientific, sort, note), decisions of people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fold = "callable from a column to a column"


def checklist_index(checklist: DataFrame, fold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First row by the file's order for each folded common name, scientific name, and scientific name among sub-forms."""
    rec = F.struct("code", "common", "scientific", "sort", "report_as")
    species = checklist.where("category = 'species'")

    def first(rows: DataFrame, name: str, out: str) -> DataFrame:
        return rows.groupBy(fold(F.col(name)).alias(f"{out}_key")).agg(F.min_by(rec, "seq").alias(out))

    return first(species, "common", "c"), first(species, "scientific", "s"), first(checklist.where("category <> 'species'"), "scientific", "f")


def form_parent(checklist: DataFrame) -> DataFrame:
    """(code, parent): the species that a sub-form reports to; null where there is none, the last row of a code wins."""
    parents = checklist.where("category = 'species'").groupBy(F.col("code").alias("pcode")).agg(F.max_by(F.struct("code", "common", "scientific", "sort"), "seq").alias("parent"))
    return checklist.where("category <> 'species'").join(parents, F.col("report_as") == F.col("pcode"), "left").select("code", "parent")


def match_ladder(accounts: DataFrame, checklist: DataFrame, overrides: DataFrame, fold) -> DataFrame:
    """(slug, common, scientific, outcome, match, suggestion, reason).

    override, then both names on one record, then the common name; a hit by the scientific name alone is
    a probable split and one among sub-forms a lump, and neither is applied.
    """
    by_common, by_scientific, by_form = checklist_index(checklist, fold)
    parents = form_parent(checklist).select(F.col("code").alias("fcode"), "parent").dropDuplicates(["fcode"])
    a = accounts.select("slug", "common", "scientific", fold(F.col("common")).alias("ck"), fold(F.col("scientific")).alias("sk"))
    o = overrides.select(F.col("slug").alias("oslug"), F.struct("code", "common", "scientific", "sort").alias("o"), F.col("note").alias("onote"))
    j = a.join(o, F.col("slug") == F.col("oslug"), "left").join(by_common, F.col("ck") == F.col("c_key"), "left").join(by_scientific, F.col("sk") == F.col("s_key"), "left")
    j = j.join(by_form, F.col("sk") == F.col("f_key"), "left").join(parents, F.col("f.code") == F.col("fcode"), "left")
    decided = F.col("o.code").isNotNull()
    outcome = (
        F.when(decided, "override").when(F.col("c.code").isNotNull() & (F.col("c.code") == F.col("s.code")), "both").when(F.col("c.code").isNotNull(), "common")
        .when(F.col("s.code").isNotNull(), "split").when(F.col("parent.code").isNotNull(), "lumped").otherwise("unmatched")
    )
    j = j.withColumn("outcome", outcome)
    part = lambda x: F.struct(F.col(f"{x}.code").alias("code"), F.col(f"{x}.common").alias("common"), F.col(f"{x}.scientific").alias("scientific"), F.col(f"{x}.sort").alias("sort"))
    match = F.when(F.col("outcome") == "override", part("o")).when(F.col("outcome").isin("both", "common"), part("c"))
    suggestion = F.when(F.col("outcome") == "split", F.col("s.code")).when(F.col("outcome") == "lumped", F.col("parent.code"))
    reason = (
        F.when(F.col("outcome") == "split", F.concat(F.lit("only the scientific name matches "), F.col("s.common")))
        .when(F.col("outcome") == "lumped", F.concat(F.lit("now a form of "), F.col("parent.common"))).when(F.col("outcome") == "unmatched", F.lit("no name matches"))
    )
    return j.select("slug", "common", "scientific", "outcome", match.alias("match"), suggestion.alias("suggestion"), reason.alias("reason"), F.col("onote").alias("override_note"))


def resolved_layer(ladder: DataFrame, fold) -> DataFrame:
    """(slug, code, current_common, current_scientific, sort, historic_common, note) of every account."""
    renamed = fold(F.col("match.common")) != fold(F.col("common"))
    note = F.coalesce("override_note", F.when(renamed, F.concat(F.lit("formerly "), F.col("common"))))
    hit = F.col("match.code").isNotNull()
    return ladder.select("slug", F.col("match.code").alias("code"), F.col("match.common").alias("current_common"), F.col("match.scientific").alias("current_scientific"), F.col("match.sort").alias("sort"), F.when(renamed, F.col("common")).alias("historic_common"), F.when(hit, note).otherwise(F.col("override_note")).alias("note"))


def pending_review(ladder: DataFrame) -> DataFrame:
    return ladder.where("outcome IN ('split', 'lumped', 'unmatched')").select("slug", "outcome", "suggestion", "reason")


def merge_override_stub(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """(slug, code, why, suggestion): decided entries stay, open ones get fresh evidence, entries without evidence stay."""
    p = pending.select(F.col("slug").alias("p_slug"), F.col("reason").alias("p_why"), F.col("suggestion").alias("p_sug"))
    d = decisions.select(F.col("slug").alias("d_slug"), "code", "why", F.col("suggestion").alias("d_sug"))
    both = p.join(d, F.col("p_slug") == F.col("d_slug"), "full")
    keep = F.col("code").isNotNull() | F.col("p_slug").isNull()
    return both.select(F.coalesce("d_slug", "p_slug").alias("slug"), "code", F.when(keep, F.col("why")).otherwise(F.col("p_why")).alias("why"), F.when(keep, F.col("d_sug")).otherwise(F.col("p_sug")).alias("suggestion"))


def tokens_overlap(want: Column, got: Column) -> Column:
    """Share of the wanted words that are there; 1 where none is wanted."""
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, got)) / F.size(want))


def override_progress(entries: DataFrame) -> DataFrame:
    """(slug, state, total, resolved) of entries with slug, code and suggestion: resolved, suggested or open; one row of counts is joined to all."""
    counts = entries.agg(F.struct(F.count("*").alias("total"), F.count("code").alias("resolved")).alias("c")).scalar()
    state = F.when(F.col("code").isNotNull(), "resolved").when(F.col("suggestion").isNotNull(), "suggested").otherwise("open")
    return entries.select("slug", state.alias("state"), counts.alias("c")).select("slug", "state", "c.total", "c.resolved")
