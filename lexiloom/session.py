"""Session helpers shared by the queries, the bench and the tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", name: str = "lexiloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the repository is on a path they share."""
    env = spark.sparkContext.environment
    paths = [p for p in (REPO, env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(os.pathsep.join(paths).split(os.pathsep)))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. A local folder stands in only where the setting is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/lexiloom-checkpoints"
    return f"{base.rstrip('/')}/lexiloom/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet in the shared folder and read back: what several branches of a plan use
    is made once, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its files hold fewer: a file of one row group is one task however
    many splits it has. Tables of more files stay as they are and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables of texts, whose rows cost enough to be spread.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name in TEXTS else read
