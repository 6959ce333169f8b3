"""Keyed tables and leases: what is written, what is read, who may write."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import lease
from millrace.sources.keyed import Conflict, KeyedTable, Manifest

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("first", T.StringType()), T.StructField("seen", T.LongType()), T.StructField("text", T.StringType())])
RULES = {"first": "first", "text": "written"}


def rows(spark, values):
    return spark.createDataFrame(values, "id long, first string, seen long, text string, written boolean")


def put(spark, table, values, **more):
    return table.upsert(rows(spark, values), F.col("written"), **more)


def test_upserts_against_a_dict(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], RULES, 4)
    assert table.read().count() == 0
    rnd, want = random.Random(2), {}
    for batch in range(6):
        values = [(k, f"f{batch}", batch, rnd.choice([None, f"t{batch}"]), rnd.random() < 0.5) for k in rnd.sample(range(40), 12)]
        put(spark, table, values, stream="s", batch=batch)
        for k, first, seen, text, written in values:
            old = want.get(k, (first, None, None))
            want[k] = (old[0], seen, text if written else old[2])
        if batch == 3:
            assert set(table.compact(3)) <= set(range(4))
    assert {r["id"]: (r["first"], r["seen"], r["text"]) for r in table.read().collect()} == want
    assert put(spark, table, [(1, "x", 99, "x", True)], stream="s", batch=5) == []  # was applied
    before = table.files()
    table.compact(0)
    assert table.files() <= 4 < before and {r["id"]: (r["first"], r["seen"], r["text"]) for r in table.read().collect()} == want


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], RULES, 16)
    put(spark, table, [(k, "a", 0, "a", True) for k in range(500)])
    assert table.files() == 16
    runs = table.manifest().files
    touched = put(spark, table, [(7, "b", 1, "b", True)])
    after = table.manifest().files
    assert len(touched) == 1 and {b for b in after if after[b] != runs[b]} == {str(touched[0])} and table.files() == 17
    assert table.compact(1) == touched  # one bucket is rewritten, fifteen stay as they are
    assert sum(after[b] != runs[b] for b, after in [(b, table.manifest().files) for b in runs]) == 1
    assert table.read_for(rows(spark, [(7, None, None, None, True)])).filter("id = 7").first()["text"] == "b"
    assert table.read().count() == 500 and table.vacuum(1) and table.read().count() == 500


def test_repeats_within_a_batch_and_conflicts(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], RULES, 2)
    put(spark, table, [(1, "a", 5, "five", True), (1, "b", 9, "nine", True), (None, "c", 1, "none", True)], order=F.col("seen"))
    assert {r["id"]: r["text"] for r in table.read().collect()} == {1: "nine", None: "none"}
    now = table.manifest()
    with pytest.raises(Conflict):
        table._commit(Manifest(now.version, now.key, now.buckets, now.rules, now.schema))
    with pytest.raises(ValueError):
        KeyedTable.create(spark, f"{tmp_path}/u", SCHEMA, ["id"], {"text": "newest"})
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"{tmp_path}/none").read()


def test_leases_fence_late_writers(spark, tmp_path):
    path = f"{tmp_path}/lease"
    first = lease.acquire(spark, path, 60)
    with pytest.raises(lease.LeaseLost):
        lease.acquire(spark, path, 60)
    second = lease.acquire(spark, path, 60, now=first.folder.modified(f"{first.number:012d}") + 61)
    assert second.number == first.number + 1
    table = KeyedTable.create(spark, f"{tmp_path}/t", SCHEMA, ["id"], RULES, 2)
    put(spark, table, [(1, "a", 1, "second", True)], lease=second)
    with pytest.raises(lease.LeaseLost):
        put(spark, table, [(1, "a", 2, "late", True)], lease=first)
    first.release()  # wakes up and lets go: the second run keeps its lease
    with pytest.raises(lease.LeaseLost):
        lease.acquire(spark, path, 60)
    second.renew()
    second.release()
    with lease.held(spark, path) as third:
        assert third.check() == 3
    assert table.read().first()["text"] == "second"
