"""Keyed tables for incremental upserts: hash buckets, deltas, a manifest, merge on read.

A table has a fixed number of buckets by the hash of its key.  An upsert writes the
rows of a batch, and nothing else, as deltas of the buckets that they fall into, and
then creates the next numbered manifest, which names the base and the deltas of
each bucket.  Creating it is atomic and fails where somebody else came first, so a
batch is in the table wholly or not at all, and readers see one manifest or the
next.  A batch that the manifest has already is not applied again.

Reading merges the versions of each key by the rule of each column:

    first    from the earliest version (ids, when something was first seen)
    last     from the latest version
    written  from the latest version that was a change, not a mere sighting

``compact`` merges the buckets that have gathered many deltas, and those alone, into
new bases.  Files that no kept manifest names are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.files import Folder
from millrace.sources.lease import Lease, LeaseLost

RULES = ("first", "last", "written")


class Conflict(RuntimeError):
    """Another writer committed first; the batch may be tried again."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: tuple[str, ...]
    buckets: int
    rules: dict[str, str]
    schema: dict
    files: dict[str, list[str]] = field(default_factory=dict)  # runs of each bucket, the base first
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each stream
    lease: int = 0  # highest number of a lease that has written
    by: tuple[str, ...] = ()  # columns of the key that choose the bucket, all of them if none

    def after(self, files: dict[str, list[str]], lease: "Lease | None", batches: dict[str, int] | None = None) -> "Manifest":
        """The next version, with other files."""
        return replace(self, version=self.version + 1, files=files, batches=self.batches if batches is None else batches, lease=max(self.lease, lease.number if lease else 0))

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)


class KeyedTable:
    """The table at ``path``; ``create`` makes a new one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifests, self.data = Folder(spark, f"{path}/manifests"), Folder(spark, f"{path}/data")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], rules: Mapping[str, str] | None = None, buckets: int = 64, by: Sequence[str] = ()) -> "KeyedTable":
        """``rules`` by column; those without one, and not in the key, are ``last``.

        ``by``: columns of the key that choose the bucket, where a reader knows only those.
        """
        table = cls(spark, path)
        schema = spark.createDataFrame([], schema.simpleString()).schema  # whatever a later version brings may be null
        every = {name: (rules or {}).get(name, "last") for name in schema.fieldNames() if name not in key}
        if bad := [name for name, rule in every.items() if rule not in RULES] + [name for name in (*key, *(rules or {})) if name not in schema.fieldNames()] + [name for name in by if name not in key]:
            raise ValueError(f"no such rule or column: {bad}")
        table._commit(Manifest(1, tuple(key), buckets, every, json.loads(schema.json()), by=tuple(by)))
        return table

    # -- manifests

    def manifest(self) -> Manifest:
        names = [name for name in self.manifests.names() if name.endswith(".json") and name[:12].isdigit()]
        if not names:
            raise FileNotFoundError(f"no table at {self.path}")
        found = json.loads(self.manifests.read(names[-1]))
        return Manifest(**found | {"key": tuple(found["key"]), "by": tuple(found["by"])})

    def _commit(self, new: Manifest) -> None:
        if not self.manifests.create(f"{new.version:012d}.json", json.dumps(new.__dict__)):
            raise Conflict(f"version {new.version} of {self.path} was committed by another writer")

    # -- writing

    def bucket_of(self, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(*(F.col(name).cast("string") for name in manifest.by or manifest.key)), F.lit(manifest.buckets)).cast("int")

    def upsert(self, rows: DataFrame, written: Column | None = None, stream: str | None = None, batch: int | None = None, order: Column | None = None, lease: Lease | None = None) -> list[int]:
        """Commits ``rows`` as the latest version of their keys; the buckets it wrote to.

        ``written`` tells changes from sightings (all rows are changes without it).
        ``rows`` may lack columns of the table, which are then null in this version.
        Where keys may repeat within ``rows``, ``order`` says which row comes last.
        A ``batch`` of a ``stream`` that was committed before does nothing.
        """
        now = self.manifest()
        if batch is not None and now.batches.get(stream or "", -1) >= batch:
            return []
        if lease and now.lease > lease.check():
            raise LeaseLost(f"{self.path} was written under lease {now.lease}")
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in now.struct]
        versions = rows.select(*columns, F.coalesce(written if written is not None else F.lit(True), F.lit(False)).alias("_written"), *([order.alias("_order")] if order is not None else []))
        if order is not None:
            whole = F.struct(*(name for name in versions.columns if name != "_order"))
            versions = versions.groupBy(*(F.col(name).alias(f"_k{i}") for i, name in enumerate(now.key))).agg(F.max_by(whole, "_order").alias("_row")).select("_row.*")
        run = f"run={now.version + 1:012d}-{uuid.uuid4().hex}"
        self._write(versions.withColumn("_version", F.lit(now.version + 1).cast("long")), now, run)
        buckets = self._buckets_in(run)
        files = now.files | {str(b): [*now.files.get(str(b), []), run] for b in buckets}
        batches = now.batches if batch is None else now.batches | {stream or "": batch}
        if lease:
            lease.check()
        self._commit(now.after(files, lease, batches))
        return buckets

    def _write(self, versions: DataFrame, manifest: Manifest, run: str) -> None:
        # a large bucket is several tasks' work: one would have to sort all of it
        versions.withColumn("bucket", self.bucket_of(manifest)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{run}")

    def _buckets_in(self, run: str) -> list[int]:
        return sorted(int(name.removeprefix("bucket=")) for name in self.data.names(run) if name.startswith("bucket="))

    # -- reading

    def _versions(self, manifest: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = manifest.files if buckets is None else {str(b): manifest.files.get(str(b), []) for b in buckets}
        paths = [f"{self.path}/data/{run}/bucket={bucket}" for bucket, runs in wanted.items() for run in runs]
        schema = T.StructType([*manifest.struct, T.StructField("_written", T.BooleanType()), T.StructField("_version", T.LongType())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, versions: DataFrame, manifest: Manifest) -> DataFrame:
        """One row per key with ``_written`` and ``_version``; aggregates, so that no key's versions are gathered."""

        def value(name: str, rule: str) -> Column:
            by = {"first": -F.col("_version"), "last": F.col("_version"), "written": F.when(F.col("_written"), F.col("_version"))}[rule]
            # in a struct, since a null may be the latest value
            return F.max_by(F.struct(F.col(name).alias("v")), by)["v"].alias(name)

        out = versions.groupBy(*manifest.key).agg(*(value(name, rule) for name, rule in manifest.rules.items()), F.bool_or("_written").alias("_written"), F.max("_version").alias("_version"))
        return out.select(*manifest.struct.fieldNames(), "_written", "_version")

    def read(self, buckets: Iterable[int] | None = None, keys: Column | None = None, versions: bool = False) -> DataFrame:
        """The rows of the present version, of some buckets and of keys that meet a condition only where given; with ``versions``, the ``_version`` that wrote each last."""
        now = self.manifest()
        stored = self._versions(now, buckets)
        merged = self._merged(stored if keys is None else stored.filter(keys), now).drop("_written")
        return merged if versions else merged.drop("_version")

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``rows`` fall into; the driver gets the numbers of those."""
        now = self.manifest()
        return self.read(row[0] for row in rows.select(self.bucket_of(now)).distinct().collect())

    # -- upkeep

    def compact(self, most: int = 8, lease: Lease | None = None) -> list[int]:
        """Merges the buckets that have more than ``most`` runs; those are rewritten, others not touched."""
        now = self.manifest()
        full = [int(bucket) for bucket, runs in now.files.items() if len(runs) > most]
        if not full:
            return []
        if lease and now.lease > lease.check():
            raise LeaseLost(f"{self.path} was written under lease {now.lease}")
        run = f"run={now.version + 1:012d}-{uuid.uuid4().hex}"
        self._write(self._merged(self._versions(now, full), now), now, run)
        files = now.files | {str(b): [run] for b in full}
        self._commit(now.after(files, lease))
        return full

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last ``keep`` manifests, and the runs that none of those names; their names.

        A writer that has not committed yet has runs of a later version, which stay.
        """
        names = [name for name in self.manifests.names() if name.endswith(".json") and name[:12].isdigit()]
        kept = [json.loads(self.manifests.read(name)) for name in names[-keep:]]
        named = {run for manifest in kept for runs in manifest["files"].values() for run in runs}
        gone = [run for run in self.data.names() if run.startswith("run=") and run not in named and int(run[4:16]) <= kept[-1]["version"]]
        for name in names[:-keep]:
            self.manifests.delete(name)
        for run in gone:
            self.data.delete(run)
        return gone

    def files(self) -> int:
        """Runs of all buckets: what a reader opens."""
        return sum(map(len, self.manifest().files.values()))


def upsert_batches(table: KeyedTable, stream: str, order: Column | None = None, compact_at: int = 8):
    """A function for ``foreachBatch``: each batch once, then buckets with many deltas merged."""

    def apply(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, stream=stream, batch=batch, order=order)
        table.compact(compact_at)

    return apply
