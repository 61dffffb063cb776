"""What several operators of this subpackage use: tables, scratch storage and row hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words, for translate() and for Java's regex.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the application's Python workers, once: they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset a local master gets a temporary folder; a cluster is refused, since its
    executors would not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("hdfs:") else (f"file://{root}" if root.startswith("/") and spark.sparkContext.master.startswith("local") else root)


_TO_DELETE: list[tuple[SparkSession, str]] = []


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _TO_DELETE:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver exits."""
    path = f"{scratch_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    _TO_DELETE.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    Any executor can be lost afterwards without recomputing df.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_plumbline_path", None)
        if path is not None:
            delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables so far: for long sessions, when no result of these operators is still to be read."""
    for at, (session, path) in reversed(list(enumerate(_TO_DELETE))):
        if session is spark:
            delete(spark, path)
            del _TO_DELETE[at]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def id_fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as the planner knows them, for sizing partitions: no data is read.

    Sources that do not know their size count as 8 MB a partition.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += size if size < 1 << 60 else df.rdd.getNumPartitions() << 23
    return total


#: Rows of a few numbers each (8 MB) that are broadcast; a table with more is joined by a shuffle.
SMALL = 500_000


def hinted(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= SMALL else df
