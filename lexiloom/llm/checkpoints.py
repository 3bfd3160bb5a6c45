"""Written tables in the shared folder that the session names in spark.checkpoint.dir.

Defined results: where the setting is unset, a local master (tests, the bench) writes to the temporary folder and any other
one is an error; a table without rows is written and read as one; discard() of what is gone already does nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/lexiloom-checkpoints"
    return f"{base.rstrip('/')}/lexiloom/{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends at files
    that every executor sees, so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
