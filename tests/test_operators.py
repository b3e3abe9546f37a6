"""Cases that the tables do not hold: year ends, order of regions, odd markup, ties, streams in two runs."""

import html
import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldbook.functions import text as T
from fieldbook.operators import archive, catalog, extract, presence, quality, resolve, spatial
from fieldbook.sources import records
from fieldbook.streaming import logs

NAMES = presence.MONTHS


def brute_summary(codes):
    present = [c != "" for c in codes]
    if not any(present):
        return "Not recorded"
    if all(present):
        return "Year-round"
    out = []
    for s in range(12):
        if present[s] and not present[s - 1]:
            e = s
            while present[(e + 1) % 12]:
                e = (e + 1) % 12
            out.append(NAMES[s] if s == e else f"{NAMES[s]}–{NAMES[e]}")
    return ", ".join(out)


def test_season_summary_over_all_patterns(spark):
    rows = [(str(i), "r", ["C" if b else "" for b in bits]) for i, bits in enumerate(itertools.product((0, 1), repeat=12))]
    got = {r.entity: r.season for r in presence.season_summary(spark.createDataFrame(rows, "entity string, region string, codes array<string>")).collect()}
    assert got == {e: brute_summary(c) for e, _, c in rows}


def test_compact_codes_round_trip(spark):
    years = spark.createDataFrame([("a", "x", list("CFURI") + [""] * 7), ("b", "y", [""] * 12)], "entity string, region string, codes array<string>")
    strings = presence.compact_encode(years)
    assert {r.codes for r in strings.collect()} == {"CFURI       ", " " * 12}
    back = {(r.entity, r.month): r.code for r in presence.compact_decode(strings).collect()}
    assert back["a", 1] == "C" and back["a", 5] == "I" and back["a", 6] == "" and back["b", 12] == "" and len(back) == 24
    short = presence.compact_decode(strings.withColumn("codes", F.lit("C")))
    assert short.where("code <> ''").count() == 2


def test_present_in_orders_by_rank_then_name(spark):
    cells = spark.createDataFrame([("b", "r", 1, "C", 5), ("a", "r", 1, "C", 5), ("z", "r", 1, "F", 4), ("q", "r", 2, "C", 5), ("n", "r", 1, "I", 1)], "entity string, region string, month int, code string, rank int")
    assert [r.entity for r in presence.present_in(cells, "r", 1, 4).orderBy("position").collect()] == ["a", "b", "z"]


@pytest.mark.parametrize(("url", "expected"), [("http://h/?region=x&month=1&min=5", ("x", 0, 5)), ("http://h/", ("", 0, 1)), ("http://h/?region=q&month=13&min=6", ("", 0, 1)), ("http://h/?region=x&month=1.5&min=0", ("x", 0, 1)), ("http://h/?region=X&month=abc", ("", 0, 1)), ("http://h/?month=12", ("", 11, 1))])
def test_parse_state(spark, url, expected):
    region = F.try_parse_url(F.col("u"), F.lit("QUERY"), F.lit("region"))
    assert tuple(spark.createDataFrame([(url,)], "u string").select(*presence.parse_state(F.col("u"), F.coalesce(region.isin("x"), F.lit(False)))).first()) == expected


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "It\x92s a \x93test\x94\xa0x", T.repair_c1) == "It’s a “test” x"
    assert one(spark, "a<br><br/>b<BR>c <em>d</em> <b>e</b> <a href='u'>f</a><a href='v'> </a> ''g''", T.clean_text) == "a\n\nb\nc *d* **e** [f](u) “g”"
    assert one(spark, "the ''Ross's Goose'' and ''''", T.clean_text) == "the “Ross's Goose” and ''''"
    assert one(spark, "<em class='x'>a</em> < i >b</ i > <STRONG id=q>c</STRONG> <a class=k href = 'u'>d</a><a name='n'></a> 1 <> 2", T.clean_text) == "*a* *b* **c** [d](u) 1 <> 2"
    assert one(spark, "Ross&rsquo;s &#8212; &eacute;t&eacute;&nbsp;&emsp;x", T.collapse_ws) == "Ross’s — été x"
    assert one(spark, "Wilson's Storm-Petrel é", T.name_fold) == "wilsons storm petrel e"
    assert one(spark, "sea bird", T.name_fold) != one(spark, "seabird", T.name_fold)
    assert one(spark, " birds.org/x ", T.clean_url) == "http://birds.org/x" and one(spark, "mailto:a@b.c", T.clean_url) is None and one(spark, None, T.clean_url) is None
    assert one(spark, "http://h/a/b.jpg?x=1", T.asset_name) == "b.jpg" and one(spark, "", T.asset_name) is None
    assert one(spark, "One. Two. Three.", T.first_sentences) == "One. Two."
    assert one(spark, None, T.collapse_ws) == ""


def test_entities_are_read_as_html_reads_them(spark):
    cases = ["&amp;lt; &eacute; &#233; &#xe9;", "", "&", "&&", "a&b", "&;", "&copy 2020", "&copyright &notit; &notin;", "&#0;&#13;&#128;&#x81;&#xD800;&#1114112;&#99999999999999999999;", "&#x1F426;&#65", "&#1;&#xFFFE;&#127;&#11;", "&#", "&#x;", "&fjlig;&NotEqualTilde;", "&AMP&LT", "&nosuchname; &lt", "&#000000000065;"]
    got = {r.x: r.y for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", T.unescape_entities(F.col("x")).alias("y")).collect()}
    assert got == {c: html.unescape(c) for c in cases}
    assert one(spark, None, T.unescape_entities) is None


def test_names_fold_by_compatibility_decomposition(spark):
    def fold(name):
        text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c for c in text.replace("-", " ").replace("_", " ") if c in " abcdefghijklmnopqrstuvwxyz").split())

    cases = ["Kakapō Škoda", "Őrség ﬁnch", "Ａnas ℌ", "Łoś øre ß", "e\u0301te\u0301", "Ǆ Ⅷ ½", "中 한국 кот", "x-y_z", "𝐁ird"]
    got = {r.x: r.y for r in spark.createDataFrame([(c,) for c in cases], "x string").select("x", T.name_fold(F.col("x")).alias("y")).collect()}
    assert got == {c: fold(c) for c in cases}


def test_gallery_hero_rules(spark):
    rows = [("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "y", False), ("b", 0, "p", False), ("b", 1, "q", False)]
    got = {(r.id, r.file): r.hero for r in extract.extract_gallery(spark.createDataFrame(rows, "id string, pos int, file string, is_hero boolean")).collect()}
    assert got == {("a", "x"): False, ("a", "y"): True, ("b", "p"): True, ("b", "q"): False}


def test_presence_table_rows_are_keyed_by_their_link(spark):
    cells = lambda s: "".join(f"<td>{'' if c == '-' else c}</td>" for c in s)
    page = f"<table><tr><a href='/e/ecoregion/south'>s</a>{cells('CC--------CX')}</tr><tr><a href='/e/ecoregion/north'>n</a>{cells('FFF')}</tr><tr><a href='/e/ecoregion/south'>again</a>{cells('RRRRRRRRRRRR')}</tr></table>"
    pages = spark.createDataFrame([(1, page), (2, "none")], "id long, html string")
    regions = spark.createDataFrame([("north", 0), ("south", 1)], "region string, pos int")
    got, warned = extract.extract_presence_table(pages, regions)
    codes = {(r.id, r.region, r.month): r.code for r in got.collect()}
    assert len(codes) == 48 and codes[1, "south", 1] == "C" and codes[1, "south", 12] == "" and codes[1, "north", 1] == "" and codes[2, "north", 5] == ""
    assert {(r.id, r.warning) for r in warned.collect()} == {(1, "row of 3 cells: north"), (1, "unknown code: X"), (2, "no table: rarity"), (1, "region missing: north")}


def test_places_are_global_however_rows_are_dealt(spark):
    rows = spark.range(5000).selectExpr("cast(id * 7919 % 613 AS int) AS key", "concat('g', id % 3) AS grp", "concat('n', id) AS name").repartition(7)
    got = catalog.ranked(rows, "key", "grp", "name").collect()
    order = sorted(got, key=lambda r: (r.key, r.grp, r.name))
    assert [r.place for r in order] == list(range(1, 5001))


def test_big_tables_and_page_blocks(spark):
    big = "<table>" + "<tr></tr>" * 6 + "</table>"
    kept, skipped = extract.skip_big_tables(spark.createDataFrame([(1, big), (2, "<table><tr></tr></table>"), (3, "<p>x</p>")], "id long, html string"))
    assert {r.id for r in kept.collect()} == {2, 3} and skipped.first().warning == "table of 6 rows skipped"
    page = "<h2>Head</h2><p>One<p>Two</p><div><ul><li>a</li><li>b</li></ul></div><p>One</p><p>Top</p><script>var t='<p>no</p>'</script>"
    assert extract.page_blocks_markdown(spark.createDataFrame([(1, page)], "id long, html string")).first().markdown == "## Head\n\nOne\n\nTwo\n\n- a\n- b"


def test_match_ladder_outcomes(spark):
    checklist = spark.createDataFrame([(1, "Blue Jay", "C c", "species", None, 1, 1), (2, "New Name", "S s", "species", None, 2, 2), (3, "Form", "F f", "form", 2, 3, 3), (4, "Grey Jay", "Other o", "species", None, 4, 4)], "code long, common string, scientific string, category string, report_as long, sort long, seq long")
    accounts = spark.createDataFrame([("a", "Blue-Jay", "C c"), ("b", "Old Name", "S s"), ("c", "Old Form", "F f"), ("d", "Grey Jay", "X x"), ("e", "None", "N n"), ("f", "None", "N n")], "slug string, common string, scientific string")
    overrides = spark.createDataFrame([("f", 4, "Grey Jay", "Other o", 4, "by hand")], "slug string, code long, common string, scientific string, sort long, note string")
    got = {r.slug: (r.outcome, r.match.code if r.match else None, r.suggestion) for r in resolve.match_ladder(accounts, checklist, overrides, T.name_fold).collect()}
    assert got == {"a": ("both", 1, None), "b": ("split", None, 2), "c": ("lumped", None, 2), "d": ("common", 4, None), "e": ("unmatched", None, None), "f": ("override", 4, None)}


def test_candidates_of_a_rejected_type_score_nothing(spark):
    rows = spark.createDataFrame([(["samish"], ["samish", "flats"], "reject", 0.9), (["samish"], ["samish"], "strong", 0.9), (["samish"], ["other"], "strong", 0.4), ([], ["x"], "weak", None)], "want array<string>, got array<string>, tier string, imp double")
    assert [r.score for r in spatial.score_candidates(rows, F.col("want"), F.col("got"), F.col("tier"), F.col("imp")).collect()] == [0.0, 6.0, 0.0, 3.0]


def test_label_point_lies_inside_a_crescent(spark):
    ring = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (4, 3), (4, 4), (0, 4)]
    rings = spark.createDataFrame([("c", [{"lon": float(x), "lat": float(y)} for x, y in ring])], "region string, ring array<struct<lon: double, lat: double>>")
    p = spatial.label_point(rings)
    assert spatial.point_in_polygon_join(p.withColumnRenamed("region", "id"), rings).count() == 1


def test_connected_names_bridge_buckets(spark):
    rows = [("Ann V Bee", None), ("Ann V. Bee", None), ("Ann Bee", None), ("Q", "http://u/"), ("R", "http://u"), ("S", None), (" ", "http://u")]
    got = {}
    for r in catalog.suspected_variants(spark.createDataFrame(rows, "name string, url string")).collect():
        got.setdefault(r.cluster, set()).add(r.name)
    assert sorted(map(sorted, got.values())) == [["Ann Bee", "Ann V Bee", "Ann V. Bee"], ["Q", "R"]]


def test_connected_names_along_a_chain(spark):
    rows = [(f"n{i:03d}", f"k{j}") for i in range(60) for j in (i, i + 1)] + [("alone", "k-"), ("z1", "q"), ("z2", "q")]
    got = {r.name: r.cluster for r in catalog.connected_names(spark.createDataFrame(rows, "name string, key string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(60)} | {"alone": "alone", "z1": "z1", "z2": "z1"}


def test_links_and_paths(spark):
    assert one(spark, "http://Countries.WWW.Site.org/A/b%20c?x=1#y", lambda c: archive.canonical_url(c, r"site\.org$")) == "http://countries.www.site.org/A/b c"
    assert one(spark, "http://else.org/a", lambda c: archive.canonical_url(c, r"site\.org$")) is None
    assert one(spark, "http://site.org/a+b.css?v=1", lambda c: archive.canonical_url(c, r"site\.org$")) == "http://site.org/a+b.css?v=1"
    assert one(spark, "x_L.JPG", archive.variant_siblings) == ["x_s.JPG", "x_t.JPG", "x.JPG"]
    for a, b, rel in (("pages/a/b.html", "pages/a/c.html", "c.html"), ("pages/a/b.html", "assets/x.png", "../../assets/x.png"), ("pages/b.html", "pages/a/c.html", "a/c.html")):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(archive.relative_path(F.col("a"), F.col("b")).alias("r")).first().r == rel


def test_manifest_last_row_wins_and_changes_are_told(spark):
    lines = spark.createDataFrame([('{"url":"a","n":1}',), ("",), ("{bad",), ('{"n":5}',), ('{"url":"a","n":2}',)], "value string")
    log = records.manifest_rows(lines, "url string, n int")
    assert [tuple(r) for r in records.latest(log, "url", "n").collect()] == [("a", 2)]
    fresh = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    stored = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, v string")
    assert {r.k: r.status for r in records.changed_records(fresh, stored, "k").collect()} == {1: "added", 2: "changed", 4: "removed"}


def test_error_digest_groups_messages(spark):
    rows = spark.createDataFrame([("x", "error", "a: bad"), ("y", "error", "b: bad"), ("z", "note", "c: bad")], "where string, severity string, message string")
    assert [tuple(r) for r in quality.error_digest(rows).collect()] == [("bad", 2)]


def test_stream_counts_once_and_takes_late_files(spark, tmp_path):
    source, table, checkpoint = f"{tmp_path}/in", f"{tmp_path}/t", f"{tmp_path}/c"
    spark.createDataFrame([(1, 5, "b"), (2, 1, "a")], "k long, seq long, v string").write.parquet(source)

    def run():
        stream = spark.readStream.schema("k long, seq long, v string").parquet(source)
        logs.manifest_stream(stream, "k", "seq", table, checkpoint).awaitTermination()
        return {r.k: r.v for r in logs.current_view(spark, table, stream.schema, "k", "seq").collect()}

    assert run() == {1: "b", 2: "a"}
    spark.createDataFrame([(1, 3, "old"), (2, 9, "new")], "k long, seq long, v string").write.mode("append").parquet(source)
    assert run() == {1: "b", 2: "new"} == run()


def test_bursts_and_sessions_as_streams(spark, tmp_path):
    """What a watermark has passed is given once, as the batch gives it; first arrivals are given at once."""
    schema = "k long, s long, n long"
    rows = [(1, 0, 1), (1, 5, 2), (1, 15, 3), (1, 15, 4), (1, 40, 5), (2, 3, 6)]
    source, end = f"{tmp_path}/in", (9, 1000, 9)
    timed = lambda t: t.select("k", F.timestamp_seconds("s").alias("ts"), "n")
    batch = timed(spark.createDataFrame(rows, schema))
    runs = {
        "bursts": lambda t: logs.debounce_latest(t, "k", "ts", "n", 10).select("n"),
        "idle": lambda t: logs.idle_sessions(t, "k", "ts", "10 seconds").select("n"),
        "first": lambda t: logs.first_arrival_per_session(t, ["k"]).select("k"),
    }
    for part in (rows, [end], [(9, 1001, 10)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    for name, run in runs.items():
        stream = timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).withWatermark("ts", "1 second")
        q = run(stream).writeStream.format("memory").queryName(f"got_{name}").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(r[0] for r in spark.table(f"got_{name}").collect())
        expected = sorted(r[0] for r in run(batch).collect()) if name != "first" else [1, 2, 9]
        assert got == expected, name
    assert sorted(r.n for r in runs["bursts"](batch).collect()) == [2, 4, 5, 6]
    assert sorted(r.n for r in runs["idle"](batch).collect()) == [1, 1, 2, 2]


def test_queries_decode_the_entities_of_their_sql(spark, tmp_path):
    """Whole tables by query and by SQL: entities without their semicolon, escaped twice, or outside the list."""
    import duckdb

    from fieldbook.plans import registry

    texts = ["a&amp</title>", "&amp;lt; &nbsp;&nbsp;x", "&eacute;t&eacute; &#233; &copy 2020", "&#39;&#39;q&#39;&#39; &middot;", "&amp", "", None]
    page = lambda t: None if t is None else f'<html lang="en"><title>{t}</title><h1>{t} h</h1><article><p>{t}</p><p>&hellip;{t}</p></article><footer>&copy; {t}</footer></html>'
    rows = [(i, f"http://h/{i}", page(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("unescape_entities", "unescape_all", "clean_text", "node_paragraphs", "visible_text", "extract_fields", "credit_text", "audit_text_fields"):
        got, expected = registry.queries()[name](spark, str(tmp_path)), duck.sql(registry.oracle_sql()[name])
        assert sorted(map(str, map(tuple, got.select(*expected.columns).collect()))) == sorted(map(str, expected.fetchall())), name


def test_sort_keys_are_rounded_as_in_their_sql(spark, tmp_path):
    import duckdb

    from fieldbook.plans import registry

    suppliers = [(k, f"s{k % 90}", k % 3, (k * 37 % 40) / 4 - 5) for k in range(1, 91)]
    tables = {"supplier": (suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), "nation": ([(k, f"N{2 - k}", 0) for k in range(3)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(0, "R")], "r_regionkey int, r_name string")}
    duck = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("taxonomic_order", "family_groups", "family_members", "siblings_topk"):
        got, expected = registry.queries()[name](spark, str(tmp_path)), duck.sql(registry.oracle_sql()[name])
        assert sorted(map(str, map(tuple, got.select(*expected.columns).collect()))) == sorted(map(str, expected.fetchall())), name
