"""Tables in the folder that driver and executors share, for cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) may leave it unset, as tests do:
    then a temporary folder is made and set.  On a cluster that is an error, as no
    other machine would see the folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def free_name(name: str, *rows: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of ``rows`` has (in any case of letters)."""
    taken = {c.lower() for r in rows for c in r.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`write_table` that no later plan reads."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    _LEFT[:] = [x for x in _LEFT if x[1] != path]


def _sweep() -> None:
    for spark, path in list(_LEFT):
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            continue
