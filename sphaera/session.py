"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str = "8", app: str = "sphaera", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), a temporary folder is made and set;
    on a cluster an absent setting is an error, as a machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        base = "file://" + tempfile.mkdtemp(prefix="sphaera-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sphaera/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, in this application's part of it."""
    return f"{_app_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once every result that reads them is written."""
    delete_path(spark, _app_dir(spark))


def materialize(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with all rows of a group in one task and groups in order, for operators that read sorted groups.

    Rows are placed by a hash of their own instead of by ``keys``: behind a join or aggregate on the same keys the planner
    would drop the exchange as needless, and adaptive execution could then split a group among tasks.
    """
    placed = df.withColumn("_place", F.xxhash64(F.lit(len(keys)), *[F.col(k) for k in keys])).repartition("_place")
    return placed.sortWithinPartitions(*keys).drop("_place")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that is no longer read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def open_parquet(path: str):
    """A parquet file of the shared folder, opened in a task by its full path."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    scheme, colon, rest = path.partition(":")
    system, inner = fs.FileSystem.from_uri(f"s3:{rest}" if colon and scheme in ("s3a", "s3n") else path)
    return pq.ParquetFile(inner, filesystem=system)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application; where it is installed anyway this changes nothing."""
    import pathlib
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="sphaera-code-") as folder:
        local = pathlib.Path(folder) / "sphaera_code.zip"
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(pathlib.Path(root.name) / f.relative_to(root)))
        shared = f"{shared_dir(spark)}/sphaera-code/{app}/sphaera_code.zip"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = path(shared).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.copyFromLocalFile(path(f"file://{local}"), path(shared))
    spark.sparkContext.addPyFile(shared)
    _SHIPPED.add(app)
