"""Every operator on awkward and on empty tables: whole results, no crash."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from fixtures import LONG, TEXTS, awkward, empty  # noqa: E402

from recordloom.llm import decontam, licenses, linededup, lm, neardup, packing, pii, quality, toxicity, urls  # noqa: E402
from recordloom.llm.queries import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 0), (4, 0), (5, 1), (6, None), (None, 1), (8, 0), (9, 1), (9, 0), (10, 0), (11, 7), (999, 1), (13, 1)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    long = " ".join(LONG.split()[100:130])
    rows = [(1, long), (2, None), (3, ""), (None, long), (5, "two words"), (5, "Two, Words"), (6, "nowhere to be found at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


def operators(labels, benchmark):
    return {
        "licenses": lambda d: licenses.scan(d),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "quality": lambda d: quality.quality(d),
        "neardup": lambda d: neardup.near_duplicates(d),
        "lm": lambda d: lm.language_model_scores(d),
        "decontam": lambda d: decontam.contamination(d, benchmark),
        "pii": lambda d: pii.pseudonymize(d, "k"),
        "linededup": lambda d: linededup.dedup_lines(d),
    }


NAMES = ["licenses", "toxicity", "quality", "neardup", "lm", "decontam", "pii", "linededup"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(spark, labels, benchmark, name):
    docs = awkward(spark)
    got = operators(labels, benchmark)[name](docs).toPandas()
    assert len(got) == len(TEXTS) + 3
    assert sorted(got["doc_id"].dropna().astype(int)) == sorted([*range(len(TEXTS)), 3, 7])


@pytest.mark.parametrize("name", NAMES)
def test_nothing_from_nothing(spark, labels, benchmark, name):
    assert operators(labels, benchmark)[name](empty(spark)).count() == 0


def test_packing_keeps_every_row(spark):
    got = packing.pack_documents(awkward(spark), tokenizer_path()).toPandas()
    assert (got["piece"] == 0).sum() == len(TEXTS) + 3
    assert packing.pack_documents(empty(spark), tokenizer_path()).count() == 0


def test_stages_return_the_columns_they_got(spark, labels, benchmark):
    docs = awkward(spark)
    for stage in (toxicity.remove_toxic(docs, labels), neardup.keep_one_per_class(docs), decontam.remove_contaminated(docs, benchmark)):
        assert stage.columns == docs.columns
        assert stage.count() > 0
    assert linededup.dedup_lines(docs).columns == [*docs.columns, "_n_gone"]


CLASHING = "_h _id _th _gone _m _new _gaps _found _score _n_gone _entities _k _t _y id th fp place runs head row TEXT_ _H rank idx".split()


def test_no_name_of_a_column_clashes(spark, labels, benchmark):
    """Whatever other columns are called, they come through as they are."""
    from pyspark.sql import functions as F

    docs = awkward(spark)
    names, seen = [], {c.lower() for c in docs.columns}
    for n in CLASHING:
        if n.lower() not in seen:
            names.append(n)
            seen.add(n.lower())
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in names])
    stages = {
        "toxic": toxicity.remove_toxic(docs, labels), "near": neardup.keep_one_per_class(docs), "similar": neardup.keep_one_per_class(docs, words=5, similarity=0.8), "contaminated": decontam.remove_contaminated(docs, benchmark),
        "lines": linededup.dedup_lines(docs).drop("_n_gone"), "pii": pii.pseudonymize(docs, "k").drop("_entities"),
    }
    for name, stage in stages.items():
        own = [n for n in names if n not in {"lines": ["_n_gone"], "pii": ["_entities"]}.get(name, [])]
        rows = stage.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n}-{'null' if r['doc_id'] is None else r['doc_id']}" for n in own), (name, r["doc_id"])


def test_a_text_of_its_own_stays_whatever_its_id(spark):
    a, b = "one two three four five six seven eight nine ten", "something else entirely is said in this text of mine"
    df = spark.createDataFrame([(1, a), (3, a), (3, b), (3, b), (None, a), (None, "x y z of no other")], "doc_id long, text string")
    for stage in (neardup.keep_one_per_class(df), neardup.keep_one_per_class(df, words=5, similarity=0.8)):
        got = sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in stage.collect())
        assert got == [(False, 1, a), (False, 3, b), (True, None, "x y z of no other")]


@pytest.mark.parametrize("what", ["awkward", "empty", "small"])
def test_the_whole_pipeline(spark, labels, benchmark, tmp_path, what):
    import corpus_pipeline

    where = str(tmp_path)
    if what == "small":
        where = "/root/testdata/sf0.001"
    else:
        (awkward(spark) if what == "awkward" else empty(spark)).write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        benchmark.write.parquet(f"{where}/benchmark.parquet")
    got = corpus_pipeline.run(spark, where)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = got.count()
    assert (n == 0) if what == "empty" else n > 3
    full = got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count()
    assert full == 0


def test_stages_on_nothing(spark, labels, benchmark):
    docs = empty(spark)
    for stage in (toxicity.remove_toxic(docs, labels), neardup.keep_one_per_class(docs), decontam.remove_contaminated(docs, benchmark), linededup.dedup_lines(docs)):
        assert stage.count() == 0


def test_without_labels_or_benchmark(spark, labels, benchmark):
    docs = awkward(spark)
    got = toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in got] == [0.5]
    assert decontam.contamination(docs, benchmark.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (3, "no scheme", "<html>"), (None, "http://a.com/de/1", None), (5, "HTTP://EXAMPLE.ORG", "x"), (6, "http://a.com?x=1#y", "<link rel='canonical' href='http://b.com/de/'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.verdicts(df).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (None, "a.com", "/de/1", "com/de/", "block"), (5, "example.org", "", None, "allow"), (6, "a.com", "", None, "block")}
    assert urls.verdicts(df.limit(0)).count() == 0
