"""The pipeline on a small corpus with planted cases, against what each case should meet."""

import hashlib

import corpus_pipeline
import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    from tests.llm.test_text_operators import prose

    letters = {"en": "abcdefgh", "fr": "hijklmno"}
    item = prose(77, 40, "abcdefgh")
    rows = [(i, prose(i, 60, letters[x]), x, "s", 0) for i, x in enumerate(["en", "fr"] * 30)]
    rows += [(100, None, "en", "s", 0), (101, "1234 5678", "fr", "s", 0)]  # no language
    rows += [(102, rows[0][1], "en", "s", 0), (103, rows[1][1] + " " + prose(5, 2, letters["fr"]), "fr", "s", 0)]  # copies
    rows += [(104, prose(200, 30, "abcdefgh") + " " + item, "en", "s", 0)]  # contaminated
    rows += [(105, prose(201, 60, "abcdefgh") + " password=abcdefgh1234", "en", "s", 0)]  # a secret
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == {*range(60), 105}
    assert got[0].decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    assert got[105].decoded_sha256 == hashlib.sha256((prose(201, 60, "abcdefgh") + " [SECRET]").encode()).hexdigest()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def tables(spark, path, docs, schema="doc_id long, text string, lang string, source string, n_chars long, row string"):
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


ITEM = "seven slow turtles carried a wooden clock across the frozen river before the early morning bells rang out twice"


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    import random

    import corpus_pipeline

    r = random.Random(5)
    speech = {g: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(300)] for g, a in (("en", "abcdefghijklm"), ("fr", "éèàçnopqrstuvwxyz"))}
    say = lambda g, n: " ".join(r.choice(speech[g]) for _ in range(n))
    docs = [(i, say(g, 120), g, "s", 0, "x") for i, g in enumerate(["en", "fr"] * 20)]
    base, odd = say("en", 150), say("fr", 150)
    docs += [(100, base, "en", "s", 0, "x"), (101, base, "en", "s", 0, "x"), (101, base, "en", "s", 0, "x"), (102, base + " more", None, "s", 0, "x")]
    docs += [(200, odd, "fr", "s", 0, "x"), (200, say("en", 90), "en", "s", 0, "x"), (None, say("en", 80), "en", "s", 0, "x"), (None, say("fr", 80), "fr", "s", 0, "x")]
    docs += [(300, None, "en", "s", 0, "x"), (301, "", "en", "s", 0, "x"), (302, "12 34 ... !!", None, "s", 0, "x"), (303, say("en", 60_000), "en", "s", 0, "x"), (304, f"{ITEM} {say('en', 10)}", "en", "s", 0, "x"), (305, say("en", 50) + " password=hunter2000x", "en", "s", 0, "x")]
    tables(spark, tmp_path, docs)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = sorted((x.doc_id is not None, x.doc_id) for x in got.collect())
    assert ids == sorted([(True, i) for i in [*range(40), 100, 200, 303, 305]] + [(False, None)] * 2)
    masked = corpus_pipeline.mask_secrets(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string"), str(tmp_path))
    assert masked.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"] and "hunter2000x" not in masked.where("doc_id = 305").first().text


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    import corpus_pipeline

    tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
