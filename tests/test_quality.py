"""Declared schemas and renaming within nested records."""

import datetime
import json

import pytest

from fieldbook.operators import catalog, quality

BIRD = {
    "fields": {
        "slug": {"required": True, "pattern": "^[a-z-]+$"},
        "sort": {"type": "number", "min": 1, "max": 9},
        "seen": {"type": "boolean"},
        "family": {"required": True, "fields": {"name": {"required": True}}},
        "photos": {"exactly_one": "hero", "items": {"fields": {"file": {"required": True}, "hero": {"type": "boolean"}, "credit": {"fields": {"name": {"required": True}}}}}},
        "codes": {"min_items": 2, "max_items": 3, "items": {"required": True, "one_of": ["C", "U", ""]}},
    }
}
CASES = [
    ({"slug": "gull", "family": {"name": "Laridae"}}, []),
    ({"slug": "gull", "sort": 3.5, "seen": False, "family": {"name": "x"}, "photos": [{"file": "a", "hero": True, "credit": {"name": "n"}}, {"file": "b"}], "codes": ["C", ""], "more": 1}, []),
    ({}, [("slug", "required"), ("family", "required")]),
    ({"slug": "Gull", "sort": "many", "seen": "no", "family": {"name": None}}, [("slug", "not like ^[a-z-]+$"), ("sort", "not a number"), ("seen", "not a boolean"), ("family.name", "required")]),
    ({"slug": "g", "sort": 0, "family": {"name": "x"}, "photos": [], "codes": []}, [("sort", "under 1"), ("codes", "under 2 items")]),
    ({"slug": "g", "sort": 10, "family": {"name": "x"}, "photos": [{"hero": True}, {"file": "b", "hero": True, "credit": {}}], "codes": ["C", None, "Q", "U"]}, [("sort", "over 9"), ("photos", "hero: not exactly one"), ("photos.0.file", "required"), ("photos.1.credit.name", "required"), ("codes", "over 3 items"), ("codes.1", "required"), ("codes.2", "not one of C, U, ")]),
    ({"slug": "g", "family": {"name": "x"}, "photos": [{"file": "a"}]}, [("photos", "hero: not exactly one")]),
]


def test_records_against_a_declared_schema(spark):
    texts = [json.dumps(c) for c, _ in CASES] + ["{broken", None, "[1]", ""]
    wants = [w for _, w in CASES] + [[("", "no record")]] * 4
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    checked = quality.validated(rows, "text", BIRD)
    got = {r.n: [tuple(i) for i in r.issues] for r in checked.collect()}
    assert got == dict(enumerate(wants))
    assert sorted(r.n for r in quality.accepted(checked).collect()) == [i for i, w in enumerate(wants) if not w]
    assert sorted(r.n for r in quality.quarantined(checked).collect()) == [i for i, w in enumerate(wants) if w]


def test_schemas_that_say_what_is_not_known(spark):
    with pytest.raises(ValueError, match="no such rule"):
        quality.declared_type({"fields": {"a": {"requird": True}}})
    with pytest.raises(ValueError, match="by its fields"):
        quality.validated(spark.createDataFrame([("x",)], "text string"), "text", {"items": {}})


RECORDS = "slug string, photos array<struct<file: string, credit: struct<name: string, url: string>, hero: boolean>>, other int"


def test_a_credit_renamed_in_place(spark):
    rows = [
        ("a", [("1", (" Ann Bee", "http://old"), True), ("2", ("Ann B.", None), False), ("3", ("Ann Bee", None), False)], 1),
        ("b", [("4", ("Cee", "http://c"), True)], 2), ("c", [], 3), ("d", None, 4), ("e", [("5", None, True), ("6", (None, "http://x"), False)], 5),
    ]
    t = spark.createDataFrame(rows, RECORDS)
    plain = lambda d: {r.slug: (None if r.photos is None else [(p.file, p.credit and tuple(p.credit), p.hero) for p in r.photos], r.other, r.renamed) for r in d.collect()}
    got = plain(catalog.rename_credit(t, "Ann Bee ", " Ann Bea"))
    want = {s: (p, o, 0) for s, p, o in rows}
    want["a"] = ([("1", ("Ann Bea", "http://old"), True), ("2", ("Ann B.", None), False), ("3", ("Ann Bea", None), False)], 1, 2)
    assert got == want
    got = plain(catalog.rename_credit(t, "Ann Bee", "Z", url="http://new"))
    assert got["a"][0][0][1] == ("Z", "http://new") and got["a"][0][2][1] == ("Z", "http://new") and got["b"] == want["b"]
    cleared = catalog.rename_credit(t, "Ann Bee", "Z", url="")
    assert plain(cleared)["a"][0][0][1] == ("Z", None)
    assert catalog.rename_credit(t, "Ann Bee", "Z").drop("renamed").schema["photos"].dataType.simpleString() == t.schema["photos"].dataType.simpleString()
    account = catalog.rename_account({"birds": cleared, "sites": cleared.where("slug = 'b'"), "none": cleared.where("false")})
    assert {tuple(r) for r in account.collect()} == {("birds", 1, 2), ("sites", 0, 0), ("none", 0, 0)}
    with pytest.raises(ValueError, match="both names"):
        catalog.rename_credit(t, "Ann Bee", " ")


def test_a_record_is_read_once_to_tell_its_issues(spark, tmp_path):
    from fieldbook.plans import quality_queries

    line = [(1, k, 7, 1, 50.0 if k == 2 else 3.0, "A") for k in range(1, 4)]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, "F", "1-URGENT", datetime.date(1994, 1, 1), 5.0), (2, "F", "1-URGENT", datetime.date(1994, 1, 1), 5.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = quality_queries.schema_issues(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, "lines.1.quantity", "over 45"), (2, "lines", "required")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
