"""Cutting a plan: a DataFrame is written once to shared storage and read back as a table.

Stages whose result must not be computed twice (range slices, model hand-off) go through
``cut_lineage``. The table survives lost executors, and its exact size lets Catalyst choose joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete the shuffles of a job that has ended, instead of waiting for the driver's GC.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_tables: set[str] = set()


def cut_lineage(
    df: DataFrame, name: str = "table", drop_shuffles: bool = True, codec: str | None = None
) -> DataFrame:
    """``df`` written and read back; ``drop_shuffles`` deletes at once what its job shuffled.

    Else shuffles of all stages lie on disk together, until the driver happens to collect its garbage.

    ``codec`` is that of the files, if not the session's: texts take less room with ``zstd``.
    """
    conf = df.sparkSession.conf
    path = scratch_path(df.sparkSession, name)
    _tables.add(path.rsplit("/", 1)[1])
    before = conf.get(CLEANUP, None)
    if drop_shuffles:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if drop_shuffles:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(df: DataFrame) -> None:
    """Deletes the tables of ``cut_lineage`` that ``df`` reads, and nothing else. No one may need them any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.rsplit("/", 1)[1] in _tables:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
