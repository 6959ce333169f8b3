"""Writers: whole-table swaps, version partitions, text and JSON output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


POINTER = "CURRENT"


def swapped(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replaces a versioned table by ``df``, which may read it; ``current`` reads it.

    The new version is written whole into a folder of its own; then a pointer
    file is replaced in one rename, so there is a table at every moment.  The version
    before stays for those who still read it, older ones are deleted.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before = _pointer(spark, path)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, place = _fs(spark, path)
    fresh, pointer = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_{version}", POINTER))
    out = fs.create(fresh, True)
    out.writeBytes(version)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fresh, pointer, options)
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def _pointer(spark: SparkSession, path: str) -> str | None:
    fs, _ = _fs(spark, path)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    return spark.read.text(pointer.toString()).first()[0] if fs.exists(pointer) else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that ``swapped`` writes."""
    version = _pointer(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """A versioned table with the partitions (score versions, for example) that ``df`` has rows of replaced.

    The new version is complete before one rename makes it the present one; the driver
    gets the values of the partitions.
    """
    spark = df.sparkSession
    if _pointer(spark, path) is None:
        return swapped(df, path, (partition,))
    values = [row[0] for row in df.select(partition).distinct().collect()]
    kept = current(spark, path).filter(~F.coalesce(F.col(partition).isin(values), F.lit(None in values)))
    swapped(kept.select(*df.columns).unionByName(df), path, (partition,))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Saves a table bucketed and sorted by a key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def as_lines(df: DataFrame) -> DataFrame:
    """``df`` with ``line``: its columns at fixed widths, which one aggregate over all rows finds; nulls are empty."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    row = df.agg(*(F.greatest(F.coalesce(F.max(F.length(s)), F.lit(0)), F.lit(len(c))).alias(f"w{i}") for i, (s, c) in enumerate(zip(shown, df.columns)))).first()
    cells = [F.rpad(s, row[i], " ") for i, s in enumerate(shown)]
    return df.withColumn("line", F.rtrim(F.concat_ws("  ", *cells)))


def as_table(df: DataFrame, most: int = 100) -> str:
    """A fixed-width table of the first rows, for a terminal."""
    rows = [[("" if v is None else str(v)) for v in row] for row in df.limit(most).collect()]
    widths = [max(map(len, column)) for column in zip(df.columns, *rows)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in (df.columns, ["-" * w for w in widths], *rows)]
    return "\n".join(lines)
