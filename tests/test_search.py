"""The stored index against a scan of the texts."""

import math
import random
import re

import pytest

from millrace.operators import search


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_hand(rows, query):
    bags = {i: [w for w in re.split(r"\W+", (text or "").lower()) if w] for i, text in rows}
    wanted = set(re.split(r"\W+", query.lower())) - {""}
    mean = sum(map(len, bags.values())) / len(bags)
    df = {w: sum(w in bag for bag in bags.values()) for w in wanted}
    part = lambda bag, w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag.count(w) * 2.2 / (bag.count(w) + 1.2 * (0.25 + 0.75 * len(bag) / mean))
    return {i: pytest.approx(sum(part(bag, w) for w in wanted)) for i, bag in bags.items() if wanted and wanted <= set(bag)}


def told(index, query):
    return {r["id"]: r["score"] for r in search.found(index, query).collect()}


def test_search_and_updates(spark, tmp_path):
    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice(["the", "The", "license", "of", "tree", "Öl", "x_1", "a-b"]) for _ in range(rnd.randint(0, 12)))
    rows = {i * 37: text() for i in range(150)} | {5: None, 6: "", 7: "only here"}
    index = search.build(spark, f"{tmp_path}/i", documents(spark, list(rows.items())), buckets=4)
    queries = ("the", "license, THE!", "öl x_1", "only here", "absent", "the absent", "", "b")
    for query in queries:
        assert told(index, query) == by_hand(list(rows.items()), query), query
    runs = index.files()
    changed = {37: "now of other words", 7: "", 5: "the new one", 9000: "a text that came later"}
    rows |= changed
    search.update(index, documents(spark, list(rows.items())), documents(spark, list(changed.items())))
    for query in (*queries, "new one", "later"):
        assert told(index, query) == by_hand(list(rows.items()), query), query
    assert index.files() <= runs + 4  # deltas, not a new index
    top = search.best(index, "the", 3).collect()
    assert [r["id"] for r in top] == [i for i, _ in sorted(by_hand(list(rows.items()), "the").items(), key=lambda x: (-x[1].expected, x[0]))[:3]]


def test_search_reads_its_words_only(spark, tmp_path):
    index = search.build(spark, f"{tmp_path}/i", documents(spark, [(i, f"word{i} common") for i in range(300)]), buckets=16)
    plan = search.found(index, "word7 common")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word" in plan.split("PushedFilters")[1]  # the scan takes the words over
    assert len({part for part in re.findall(r"bucket=\d+", " ".join(search._read(index, ["word7"]).inputFiles()))}) == 1
    assert told(index, "word7 common").keys() == {7}


def test_lists_shuffle_texts_once(spark):
    listed = search.lists(documents(spark, [(1, "a b a")]))
    assert listed._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # no row for each word is dealt out


def test_update_does_not_read_the_index(spark, tmp_path):
    rows = {i: f"word{i} common" for i in range(0, 5000, 7)}
    index = search.build(spark, f"{tmp_path}/i", documents(spark, list(rows.items())), buckets=4)
    index.read = None
    gone = [i for i in rows if i < 1024]  # a block without a text any more
    rows = {i: t for i, t in rows.items() if i >= 1024} | {1400: "word7 another", 1401: "now"}
    search.update(index, documents(spark, list(rows.items())), documents(spark, [(i, None) for i in [*gone, 1400, 1401]]))
    del index.read
    for query in ("common", "word7", "word14 common", "word1400", "word1407 common", "another"):
        assert told(index, query) == by_hand(list(rows.items()), query), query
    index.compact(most=1)
    assert told(index, "common") == by_hand(list(rows.items()), "common") and told(index, "word14") == {}


def test_blocks_of_many_batches(spark, tmp_path):
    rows = [(i, "the tree" if i % 3 else "the the Tree") for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        index = search.build(spark, f"{tmp_path}/i", documents(spark, rows), buckets=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert told(index, "tree the") == by_hand(rows, "tree the")
