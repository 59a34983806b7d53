"""Search by trigram index against the plain filter."""

import re

import pytest

from tallyhire.functions.text import contains_typed
from tallyhire.operators import search
from tallyhire.operators.search import SearchStore

ROWS = "id string, company string, title string, location string"


def postings(spark):
    rows = [(f"id-{i}", f"Company {i % 7}", f"{w} Engineer {i}", p) for i, (w, p) in enumerate(
        [("Platform", "Berlin"), ("Data", "INDIA"), ("x\\y", ""), ("Straße", None), ("🙂🙂🙂 fun", "a\nb\nc")] * 40)]
    rows += [("empty", "", "", ""), ("nulls", None, None, None), ("short", "ab", "c", "Zz")]
    return spark.createDataFrame(rows, ROWS)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return SearchStore(spark, str(tmp_path_factory.mktemp("search")), shards=8, buckets=4).build(postings(spark))


@pytest.mark.parametrize("typed", ["platform", " PLAT ", "india", "\\y ", "straße", "🙂🙂🙂", "🙂", "ab", "z", "eng%er 1", "da_a",
                                   "%", "b\nc", "no such text", "er 12", "a\nb", ""])
def test_search_finds_what_the_filter_finds(spark, store, typed):
    holds = [contains_typed(c, typed.strip()) for c in search.FIELDS]
    want = postings(spark).filter(holds[0] | holds[1] | holds[2]) if typed.strip() else postings(spark)
    assert ids(store.find(typed)) == ids(want)
    assert ids(store.find(typed, ["title"])) == ids(postings(spark).filter(holds[1]) if typed.strip() else want)


def test_only_buckets_and_shards_of_candidates_are_read(spark, store):
    plan = store.find("engineer 17", ["title"])
    assert ids(plan) == sorted(["id-17", *[f"id-17{k}" for k in range(10)]])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"/rows\], PartitionFilters: \[[^\n]*dynamicpruning", text)
    assert re.search(r"/grams\], PartitionFilters: \[[^\]]*\(bucket#\d+ = \d\)", text) and "EqualTo(gram, 17)" in text
    assert store.candidates("ab", ["title"]) is None and store.candidates("qqq", ["title"]).count() == 0


def test_a_frequent_text_scans_instead_of_broadcasting(spark, store, monkeypatch):
    monkeypatch.setattr(search, "MOST_CANDIDATES", 5)
    assert store.candidates("engineer", ["title"]) is None
    assert len(ids(store.find("engineer", ["title"]))) == 200


def test_an_upsert_keeps_the_index_whole_and_may_run_again(spark, tmp_path):
    store = SearchStore(spark, str(tmp_path), shards=4, buckets=4).build(postings(spark))
    changed = spark.createDataFrame([("id-0", "Company 0", "Gardener", "Oslo"), ("new", "Fresh", "Gardener", None)], ROWS)
    for batch_id in ("1", "1", "2"):
        merged = postings(spark).join(changed, "id", "left_anti").unionByName(changed)
        store.merge(changed, merged, batch_id)
        assert ids(store.rows()) == ids(merged)
        assert ids(store.find("gardener")) == ["id-0", "new"] and ids(store.find("fresh")) == ["new"]
        assert "id-0" not in ids(store.find("platform"))
    assert store.rarest("gardener", ["title"])["title"][1] == 4  # two batches hold it; a count may be too large, never too small
    store.build(store.spark.createDataFrame(store.rows().drop("shard").collect(), ROWS))
    assert store.rarest("gardener", ["title"])["title"][1] == 2


def test_an_empty_table_finds_nothing(spark, tmp_path):
    store = SearchStore(spark, str(tmp_path), shards=4, buckets=4).build(spark.createDataFrame([], ROWS))
    assert store.find("platform").count() == 0 and store.find("").count() == 0
