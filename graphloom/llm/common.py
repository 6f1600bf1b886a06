"""What several operators share: table access, shared storage, word rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` has the same rule.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return spark.sparkContext.getCheckpointDir()


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    Every executor can reread the files, so a lost executor costs no recomputation,
    and values that depend on task order (row ids, boundaries) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Deletes the tables that ``shared_table`` wrote; runs at exit, or call it between jobs."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def shield(df: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``own`` renamed, so that none clashes with a working column, and the columns that restore it."""
    names = {c: c if c in own else f"_shielded{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def ascii_lower(c: Column) -> Column:
    """A-Z only; ``lower`` would also change other scripts."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once and not at each use. A body of two arguments would get an index too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def how_many(holds: Callable[[Column], Column], most: int) -> Column:
    """How many of the places 0, 1, ... below ``most`` hold, by halving; those that do come first, and null doesn't."""

    def ahead(step: int) -> Callable[[Column], Column]:
        return lambda i: F.when(F.coalesce(holds(i + F.lit(step - 1)), F.lit(False)), i + F.lit(step)).otherwise(i)

    at, step = F.lit(0), 1 << max(0, most.bit_length() - 1)
    while step:
        at = let(at, ahead(step))
        step >>= 1
    return at


def numbered(rows: DataFrame, key: Sequence[str], order: str, name: str, parts: int = 64) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each key. ``order`` tells rows apart and must be fixed; a hot key is numbered in parts."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)).cast("int"))
    key_of = F.struct(*key).alias("_key_of")
    counts = rows.groupBy(key_of, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_key_of", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_key_of", "_part").orderBy(order))
    # a struct of nulls equals another one, so null keys find their counts
    out = rows.withColumn("_key_of", key_of).withColumn("_nth_of", nth).join(counts, ["_key_of", "_part"])
    return out.withColumn(name, F.col("_nth_of") + F.col("_before")).drop("_key_of", "_part", "_nth_of", "_before")
