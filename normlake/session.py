"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "normlake", **conf: str) -> SparkSession:
    """A session with the settings that the queries expect: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context: they need not have it installed, nor share a folder with the driver."""
    context = spark.sparkContext
    if getattr(context, "_normlake_code", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="normlake-"), "normlake_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith((".py", ".json")):
                    z.write(os.path.join(folder, n), os.path.join("normlake", os.path.relpath(os.path.join(folder, n), top)))
    context.addPyFile(path)
    context._normlake_code = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. One of our own only where that is unset and the driver is the
    only executor; on a cluster there is none to fall back on, as every machine would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} intermediate results need a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "normlake-checkpoints")
    return where.rstrip("/")


#: Folders that materialize() has written and nobody has dropped, by session.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: plans that use it several times don't compute it anew, nor do lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/normlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._normlake_path = path
    return out


def mark(spark: SparkSession) -> int:
    """A point to which drop_since() goes back."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, point: int, keep: int = 0) -> None:
    """Delete what was materialized after `point`, but for the last `keep`. No frame that is still to be computed may read from it."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    _delete(spark, paths[point : len(paths) - keep])


def drop(*frames: DataFrame) -> None:
    """Delete what these frames, made by materialize(), read. No frame that is still to be computed may read from it."""
    for f in frames:
        _delete(f.sparkSession, [f._normlake_path])


def _delete(spark: SparkSession, gone: list[str]) -> None:
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths[:] = [p for p in paths if p not in gone]
