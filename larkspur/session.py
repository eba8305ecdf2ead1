"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_shipped: set[str] = set()  # applications that have the package already
_local_roots: list[str] = []  # one temporary folder per local-mode process
_made: list[str] = []  # folders of this process under the work folder


def build_session(
    app: str = "larkspur",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC times.

    Nothing here is needed for right results; a session made elsewhere works.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session.

    Arrow functions name code in this package, so every executor needs it.
    Done once per application; installing the package on all hosts works too.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _folders, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def work_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder; on a cluster, and in local-cluster mode, a folder of one process
    would be lost with it, so the setting is then required.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if not _local_roots:
        _local_roots.append(tempfile.mkdtemp(prefix="larkspur-"))
    return _local_roots[0]


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder path under the shared work folder (not yet created).

    It belongs to this process until ``clear_work`` removes it.
    """
    _made.append(f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_work(spark: SparkSession, path: str) -> bool:
    """Delete one folder made by ``work_dir`` that nothing will read again; whether it existed."""
    if path in _made:
        _made.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


def clear_work(spark: SparkSession) -> int:
    """Delete the intermediate folders of this process; the number of those that existed.

    Call it when no DataFrame that reads them is needed any more, at the end of
    a job at the latest.
    """
    removed = 0
    while _made:
        removed += remove_work(spark, _made[-1])
    return removed


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The stored copy survives the loss of executors, and a later retry starts
    from it rather than from the beginning of the plan.
    """
    path = work_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
