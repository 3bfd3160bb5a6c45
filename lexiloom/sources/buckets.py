"""A table in buckets of its key: a change reads and writes only the buckets of the rows that it touches.

Each write makes a folder with the new content of its buckets; the table's state (`versions`) says which folder holds each
bucket. Readers of an earlier state still find its folders. Of two writers that began from one state the second gets a Conflict and
can begin anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.sources import versions
from lexiloom.sources.versions import Conflict

__all__ = ["BucketTable", "Conflict"]
BUCKETS = 64


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        #: Fixed by the first write.
        self.buckets = self.state()[1].get("buckets", buckets)

    def state(self) -> tuple[int, dict]:
        """Number and content: `folders` has the folder of each bucket that has rows."""
        return versions.latest(self.spark, f"{self.root}/states")

    def bucket_of(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None, state: dict | None = None) -> DataFrame:
        """The newest rows, or those of some buckets; other buckets' files aren't listed."""
        folders = (self.state()[1] if state is None else state).get("folders", {})
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, f in sorted(folders.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> tuple[str, set[int]]:
        """The folder of the rows, and the buckets in it."""
        folder = uuid.uuid4().hex
        columns = [f.strip().split()[0] for f in self.schema.split(", ")]
        rows.select(*columns).withColumn("bucket", self.bucket_of()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        found = versions.names(self.spark, f"{self.root}/data/{folder}")
        return folder, {int(n.partition("=")[2]) for n in found if n.startswith("bucket=")}

    def replace(self, rows: DataFrame) -> int:
        """All rows anew."""
        number, _ = self.state()
        folder, found = self._write(rows)
        return versions.commit(self.spark, f"{self.root}/states", number, {"buckets": self.buckets, "folders": {str(b): folder for b in found}})

    def change(self, keys: DataFrame, made: Callable[[DataFrame], DataFrame]) -> int:
        """Put made(old rows) in place of the rows of the buckets that hold any of the keys; made() must
        keep the rows that it doesn't change."""
        number, state = self.state()
        hit = {r.b for r in keys.select(self.bucket_of().alias("b")).distinct().collect()}  # as many as there are buckets
        if not hit:
            return number
        folder, found = self._write(made(self.read(hit, state)))
        folders = {b: f for b, f in state.get("folders", {}).items() if int(b) not in hit} | {str(b): folder for b in found}
        return versions.commit(self.spark, f"{self.root}/states", number, {"buckets": self.buckets, "folders": folders})
