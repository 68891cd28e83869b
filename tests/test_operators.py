"""Rules of the record engine on small literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import citations, components, counting, coverage, duties, entities, evidence, graph, index, ledger, ranges, search, textquality, workflow
from recordloom.sources import files, html


def column(spark, rule, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(rule(F.col("v"))).collect()]


def test_placeholders_are_absent(spark):
    assert column(spark, S.or_null, "--", " --- ", "", " x ", None) == [None, None, None, "x", None]


def test_printed_dates_are_shapes(spark):
    assert column(spark, S.printed_date, "8/5/2026", "13/40/2024", "2026-08-05") == ["2026-08-05", "2024-13-40", None]


def test_written_dates(spark):
    assert column(spark, S.written_date, "Sept 3, 2026", "September 3, 2026", "2/30/2026", None) == [datetime.date(2026, 9, 3)] * 2 + [None, None]


def test_masks(spark):
    shown = column(spark, S.masked, "a@b.org or (202) 555-0100", "fax: 202-555-0100", "no 202-555-0100")
    assert shown == ["[email] or [phone]", "fax: [phone]", "no 202-555-0100"]


def test_bots_buckets_and_bands(spark):
    assert column(spark, S.is_bot, "Googlebot/2", "Mozilla", None) == [True, False, False]
    assert [r[0] for r in spark.range(1).select(S.latency_bucket(F.lit(500))).collect()] == ["lt2000"]
    assert [r[0] for r in spark.range(1).select(S.size_grain(F.lit(65537))).collect()] == [131072]


def test_doing_business_as(spark):
    got = column(spark, S.doing_business_as, "Acme LLC d/b/a Rails", "Acme")
    assert [tuple(x) for x in got] == [("Acme LLC", "Rails"), ("Acme", None)]


def test_like_is_escaped(spark):
    assert column(spark, S.escaped_like, "50%_\\") == ["50\\%\\_\\\\"]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (20, 20), (None, 7)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 6)}, 10: 10, 11: 10, 20: 20, **{k: 100 for k in range(100, 160)}}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_appended_once(spark):
    rows = [(1, "c1", "k"), (2, "c1", "k"), (3, "c2", "k"), (4, "c3", "k")]
    events = spark.createDataFrame(rows, "id long, capture string, key string")
    known = spark.createDataFrame([("c3", "k")], "capture string, key string")
    assert sorted(r["id"] for r in ledger.appended(events, known, ["capture", "key"], "id").collect()) == [1, 3]


def test_changes_are_null_safe(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "a", "x"), (5, "a", None)]
    got = ledger.changes(spark.createDataFrame(rows, "id long, k string, p string"), "k", "id", "p")
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5]


def test_supersession_chain(spark):
    got = ledger.superseded_by(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string"), ["k"], "id")
    assert {r["id"]: r["superseded_by"] for r in got.collect()} == {1: 2, 2: None, 3: None}


def test_dense_year_keeps_all_without_one(spark):
    years = spark.createDataFrame([(2000, 5), (2001, 50), (2002, 7)], "y int, n long")
    assert counting.dense_from(years, "y", "n", 10).count() == 3
    years = spark.createDataFrame([(2000, 5), (2001, 50), (2002, 70)], "y int, n long")
    assert sorted(r["y"] for r in counting.dense_from(years, "y", "n", 10).collect()) == [2000, 2001]


@pytest.mark.parametrize(
    ("text", "tokens"), [("rail trail", (["rail"], "trail")), ("a", (["a"], None)), ("", ([], None)), ("Foo_bar", (["foo"], "bar"))]
)
def test_query_tokens(text, tokens):
    assert search.query_tokens(text) == tokens


def test_snippets(spark):
    assert column(spark, lambda c: search.snippet(c, "rail", 4), "a b c d Rail, e f", "none") == ["c d [Rail,] e", None]


def test_cut_cells_keep_offsets():
    cell = "A, Inc., B and C Co; D"
    for start, end, text, _, _ in entities.cut_cell(cell):
        assert cell[start:end] == text
    assert entities.cut_cell("Smith and Sons", frozenset({"smith and sons"})) == [(0, 14, "Smith and Sons", "party", 1.0)]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("FD 36873", "FD 36873"), ("Ex Parte No. 542", "EP 542"), ("AB–55 (Sub-No. 5X)", "AB 55 (5X)"), ("AB 55 (Sub-No. 0)", "AB 55"), ("fd 1", None), ("EP 542 (2020)", "EP 542"), (None, None)],
)
def test_keys(raw, key):
    assert citations.normal_key(raw) == key


def test_duplicate_registry_keys(spark):
    assert citations.duplicate_keys(spark.createDataFrame([("A 1", 1), ("A 1", 2), ("B 1", 3)], "key string, docket_id int")).count() == 1


def test_multiset_intersection(spark):
    row = spark.range(1).select(textquality.common_items(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "aaac"))).alias("n")).first()
    assert row["n"] == 2


def test_wilson(spark):
    lo, hi = textquality.wilson(F.lit(41), F.lit(46))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert 0.76 < r["lo"] < 0.78 and 0.95 < r["hi"] < 0.96


def test_envelopes(spark):
    rows = [('{"success":true,"data":{"rows":"<tr></tr>","total":1}}',), ("oops",), ('{"success":false}',), ('{"success":true,"data":{"message":"No court actions results found"}}',)]
    got = html.envelope(spark.createDataFrame(rows, "raw string"), "raw").collect()
    assert [r["problem"] for r in got] == [None, "not an envelope", "failed", "nothing"]


def test_snapshot_guard(spark, tmp_path):
    good, bad = spark.range(3), spark.range(1).withColumn("user_email", F.lit("x"))
    assert files.snapshot({"a": good, "h": bad}, {"a"}, {"h"}, str(tmp_path / "s")) == {"a": 3}
    assert files.manifest(spark, str(tmp_path / "s")).count() > 0
    with pytest.raises(ValueError, match="may not leave"):
        files.snapshot({"a": bad}, {"a"}, set(), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="neither"):
        files.snapshot({"a": good, "b": good}, {"a"}, set(), str(tmp_path / "u"))


def test_media_types(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "a"), (bytearray(b"PK\x03\x04...."), "a.docx"), (bytearray(b"??"), "a")], "c binary, p string")
    got = [r[0] for r in df.select(files.media_type(F.col("c"), F.col("p"))).collect()]
    assert got[0] == "application/pdf" and got[1].endswith("document") and got[2] == "application/octet-stream"


# ------------------------------------------------ orders over ranges

def test_running_sums_and_neighbours_over_ranges(spark):
    rows = [(k * 7919 % 1000, k % 13) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    told = sorted(rows)
    sums, at = {}, 0
    for k, v in told:
        at += v
        sums[k] = at
    assert {r["k"]: r["upto"] for r in ranges.running_sum(df, [F.col("k")], F.col("v"), "upto").collect()} == sums
    before = {b[0]: a[1] for a, b in zip(told, told[1:])}
    assert {r["k"]: r["was"] for r in ranges.previous(df, [F.col("k")], "v", "was").collect()} == before | {told[0][0]: None}
    assert ranges.running_sum(df.limit(0), [F.col("k")], F.col("v"), "upto").count() == 0


def test_sessions_are_those_of_one_task(spark):
    base = datetime.datetime(2024, 1, 1)
    at = [base + datetime.timedelta(minutes=m) for m in (0, 5, 14, 29, 60, 61, 500)]
    got = coverage.sessions(spark.createDataFrame([(a,) for a in at], "ts timestamp_ntz"), "ts", 15, 3).orderBy("started").collect()
    assert [(r["started"], r["n"], r["late"]) for r in got] == [(at[0], 3, False), (at[3], 1, False), (at[4], 2, False), (at[6], 1, True)]


# ------------------------------------------------ the index on disk

def _found(spark, opened, text):
    return sorted(r[0] for r in index.match(spark, opened, text).collect())


def test_index_follows_its_files(spark, tmp_path):
    where = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "Alpha beta", "x"), (2, "beta gamma", "alpha"), (3, None, None)], "k long, a string, b string").write.parquet(where)
    docs = spark.read.parquet(where)
    one = index.opened(docs, "k", {"b": 8, "a": 1})
    assert index.opened(docs, "k", {"b": 8, "a": 1}).path == one.path != index.opened(docs, "k", {"a": 1}).path
    assert (_found(spark, one, "beta alp"), _found(spark, one, "gam"), _found(spark, one, "delta"), _found(spark, one, "")) == ([1, 2], [2], [], [])
    scores = {r["k"]: r["score"] for r in index.ranked(spark, one, ["alpha"]).collect()}
    assert scores.keys() == {1, 2} and scores[2] > scores[1]
    assert one.rows(spark).count() == 3
    spark.createDataFrame([(4, "delta", "y")], "k long, a string, b string").write.mode("append").parquet(where)
    two = index.opened(spark.read.parquet(where), "k", {"b": 8, "a": 1})
    assert two.path != one.path and _found(spark, two, "delta") == [4]


def test_rows_enter_and_leave_an_index(spark, tmp_path):
    live = index.SearchIndex(str(tmp_path / "i"), "k", (("a", 1),))
    docs = spark.createDataFrame([(1, "one word"), (2, "two words"), (3, "three")], "k long, a string")
    index.add(live, docs, 0)
    index.changed(live, spark.createDataFrame([(1, "another text")], "k long, a string"), docs.where("k = 3"), 1)
    assert (_found(spark, live, "word"), _found(spark, live, "another te"), _found(spark, live, "three")) == ([2], [1], [])
    index.changed(live, spark.createDataFrame([(3, "three again")], "k long, a string"), None, 2)
    assert _found(spark, live, "three") == [3] and live.rows(spark).count() == 3


# ------------------------------------------------ evidence and duties

def test_dates_belong_to_the_number_before_them(spark):
    lines = [
        "See EP 445, slip op. at 3 (STB served Mar. 12, 2021); see also FD 36873.", "See FD  36873 (served Mar. 12, 2021)", "FD 36873. Compare Railway Case (served May 1, 2002)",
        "FD 36873 (Sub-No. 1) (served May 1, 2002)", "FD 368 (served May 1, 2002)", "FD 36873 (served May 1, 2002) and FD 36873 (served May 2, 2002)",
    ]
    got = column(spark, lambda c: evidence.served_beside(c, F.lit("FD 36873")), *lines)
    assert got == [None, "Mar. 12, 2021", None, "May 1, 2002", None, None]


def test_numbers_are_shown_short(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 12, 999.6, 1284, 250000, 2500000, 123456789)], "v double")
    assert [r[0] for r in df.select(evidence.compact(F.col("v"))).collect()] == ["0", "12", "1.0K", "1.3K", "250K", "2.5M", "123M"]
    tops = spark.createDataFrame([(float(v),) for v in (0, 3, 17, 95, 1001)], "v double")
    assert [r[0] for r in tops.select(evidence.axis_top(F.col("v"))).collect()] == [1.0, 4.0, 20.0, 100.0, 2000.0]


def test_keys_fused_with_a_footnote(spark):
    df = spark.createDataFrame([("FD 340071", ["FD 34007"]), ("FD 34007", ["FD 34007"]), ("FD 340081", ["FD 34007"]), ("FD 340071", ["FD 340071", "FD 34007"]), (None, ["FD 1"])], "k string, own array<string>")
    assert [r[0] for r in df.select(evidence.own_key(F.col("k"), F.col("own"))).collect()] == ["FD 34007", "FD 34007", "FD 340081", "FD 340071", None]


def test_paging_ends(spark):
    rows = [(1, 50, False, 50, 70), (1, 0, True, 0, 70), (2, 20, False, 70, 70), (2, 0, True, 70, 70), (2, 0, True, 50, 70)]
    df = spark.createDataFrame(rows, "page int, n int, envelope boolean, seen int, total int")
    assert [r[0] for r in df.select(duties.paging_end(F.col("page"), F.col("n"), F.col("envelope"), 50, F.col("seen"), F.col("total"))).collect()] == ["next", "trap", "end", "end", "retry"]


@pytest.mark.parametrize("few", [1000, 0])
def test_quotations_of_any_length(spark, monkeypatch, few):
    monkeypatch.setattr(textquality, "SHORT_ITEMS", few)
    text = "".join(chr(97 + k * k % 26) for k in range(4000))
    docs = spark.createDataFrame([(1, text), (2, text[:50]), (3, "")], "d long, t string")
    items = [(k, text[k * 31 : k * 31 + n]) for k, n in enumerate((3, 8, 39, 40, 45, 200))] + [(99, "~~~")]
    quotes = spark.createDataFrame(items, "i long, q string")
    got = {(r["d"], r["i"]) for r in textquality.quoted(docs, "d", F.col("t"), quotes, "i", F.col("q")).collect()}
    assert got == {(d, i) for d, t in ((1, text), (2, text[:50])) for i, q in items if q in t}


def test_short_numbers_round_their_exact_value(spark):
    """36.55 is a little less in binary; 0.5 and 2.5 are exactly half-way."""
    df = spark.createDataFrame([(v,) for v in (36550.0, -36550.0, 0.5, 1.5, 2.5, -0.4, -694450.0, 1250.0, 99950.0)], "v double")
    assert [r[0] for r in df.select(evidence.compact(F.col("v"))).collect()] == ["36.5K", "-36.5K", "0", "2", "2", "-0", "-694.5K", "1.2K", "100K"]


def test_previous_in_rounded_seconds(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, "a", at(0.6)), (2, "a", at(900.7)), (3, "a", at(1800.2)), (4, "b", at(0.4)), (5, "b", at(900.3)), (6, "c", at(0.7)), (7, "c", at(900.4)), (8, None, at(0)), (9, None, at(5000))]
    got = workflow.previous_at_least(spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz"), ["k"], "ts", 15)
    # 0.7 and 900.4 are 1 and 900 in whole seconds; 900.7 and 1800.2 are 901 and 1800.
    assert {r["id"]: r["previous"] for r in got.collect()} == {1: None, 2: at(0.6), 3: at(0.6), 4: None, 5: at(0.4), 6: None, 7: None, 8: None, 9: None}


def test_successors_by_doubling(spark, monkeypatch):
    """Chains, a fork, a cycle, a short cut and a loop, against breadth-first search; in few rounds."""
    edges = [(k, k + 1) for k in range(60)] + [(60, 100), (60, 200), (100, 101), (101, 102), (102, 60), (200, 201), (201, 300), (200, 300), (300, 300), (400, 401), (401, 400), (20, 21)]
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    want = set()
    for origin in (0, 30, 101, 400, 300, 999):
        known, front, steps = {origin}, {origin}, 0
        while front:
            front, steps = {b for a in front for b in ahead.get(a, ())} - known, steps + 1
            known |= front
            want |= {(origin, p, steps) for p in front}
    rounds = []
    kept = graph.save
    monkeypatch.setattr(graph, "save", lambda df, name: rounds.append(name) or kept(df, name))
    got = graph.successors(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(o,) for o in (0, 30, 101, 400, 300, 999)], "party long"))
    assert {tuple(r) for r in got.select("origin", "party", "steps").collect()} == want
    assert rounds.count("front") < 40
