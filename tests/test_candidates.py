"""Candidates of equal words are scored once; rows and best ones against brute force."""

import random

import pytest

from fieldbook.plans import spatial_queries as Q


@pytest.fixture
def parts(spark, tmp_path):
    r = random.Random(5)
    names = ["hot ring", "hot bolt", "cold bolt", "Ring", "bolt hot hot", None, "the park", "lone"]
    rows = [(k, r.choice(names[:-1]) if k != 300 else "lone", "b", r.choice(("ECONOMY", "STANDARD", "PROMO", "LARGE")), r.choice((1, 20, 70))) for k in range(700)]
    rows += rows[100:103]  # repeated rows count once
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path), rows


def brute(rows):
    words = lambda n: frozenset((n or "").lower().split()) - {"the", "park"}
    out = {}
    for s, sn, *_ in set(rows):
        for c, cn, _, kind, size in set(rows):
            both = words(sn) & words(cn)
            if s % 100 == 0 and s != c and both:
                base = {"ECONOMY": 3.0, "STANDARD": 1.0}.get(kind, 0.25)
                out[s, c] = 0.0 if kind == "PROMO" else round(base + 2 * len(both) / len(words(sn)) + 2 * min(size / 100, 0.5), 6)
    return out


def test_candidates_of_equal_words_are_scored_once(spark, parts, monkeypatch):
    path, rows = parts
    scored, plain = [], Q.S.score_candidates
    monkeypatch.setattr(Q.S, "score_candidates", lambda pairs, *a: scored.append(pairs.count()) or plain(pairs, *a))
    got = Q.score_candidates(spark, path).collect()
    assert {(x.site, x.cand): x.score for x in got} == brute(rows) and len(got) == len(brute(rows)) > 1000
    assert scored[0] * 4 < len(got)
    monkeypatch.setattr(Q, "LIST", 3)  # groups of several lists
    again = Q.score_candidates(spark, path).collect()
    assert sorted(again) == sorted(got)


def test_the_best_candidate_is_never_the_site(spark, parts, monkeypatch):
    path, rows = parts
    scored, plain = [], Q.S.score_candidates
    monkeypatch.setattr(Q.S, "score_candidates", lambda pairs, *a: scored.append(pairs.count()) or plain(pairs, *a))
    best = {}
    for (s, c), score in sorted(brute(rows).items(), key=lambda x: (-x[1], x[0])):
        best.setdefault(s, (c, score))
    got = {x.site: x for x in Q.best_candidate(spark, path).collect()}
    assert set(got) == set(range(0, 700, 100)) and got[300].cand is None
    assert {s: (x.cand, x.score) for s, x in got.items() if x.cand is not None} == best
    assert scored[0] * 4 < len(brute(rows))


def test_lists_serve_all_later_steps_and_hold_each_key_once(spark, tmp_path, monkeypatch):
    rows = [(k, "ring" if k % 2 else "Ring", "LARGE", None if k % 3 else 20) for k in range(400)] + [(5, "RING", "LARGE", None), (7, "the park", "LARGE", 1), (9, None, "LARGE", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "FileScan" not in Q.score_candidates(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()  # the lists serve all later steps
    monkeypatch.setattr(Q, "LIST", 20)
    sites, cands = (x.collect() for x in Q.lists(spark, str(tmp_path)))
    assert sorted(k for x in sites for k in x.sites) == [0, 100, 200, 300] and {tuple(x.want) for x in sites} == {("ring",)}
    assert sorted(k for x in cands for k in x.cands) == list(range(400)) and {tuple(x.got) for x in cands} == {("ring",)}
    assert {k for x in cands if x.imp is None for k in x.cands} == {k for k in range(400) if k % 3}
    assert len(cands) > 15 and max(len(x.cands) for x in cands) < 50  # a large group is cut


def test_few_rows_come_of_one_pair_of_lists(spark, tmp_path):
    spark.range(60000).selectExpr("id AS p_partkey", "'hot ring' AS p_name", "'LARGE' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    sites, cands = (x.collect() for x in Q.lists(spark, str(tmp_path)))
    assert sum(len(x.sites) for x in sites) == 600 and sum(len(x.cands) for x in cands) == 60000
    assert max(len(x.sites) for x in sites) * max(len(x.cands) for x in cands) < 100_000
