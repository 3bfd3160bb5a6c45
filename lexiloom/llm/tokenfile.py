"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

`write` deals documents into ranges of doc_id, sorts each range, appends the end id to every
document's ids and writes one ORC file per range, in order. Each row keeps the file's number and
how many ids stand before it in the file, so any stripe can be read on its own. `read` adds the
offsets of the files before; `find` reads single documents, where row-index statistics and the
Bloom filter on doc_id rule out stripes and row groups.

Ids come from the tokenizers library, whose model is asked once for each new pre-token; pre-tokens
already seen are kept in a bounded table per worker; what came last goes when it is full.

Defined results: a null or empty text gives the end id alone; repeated doc_ids are kept, in the
order of the fingerprints of their texts; an empty table gives no file rows and an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import textkernel as K
from lexiloom.llm.bpe import byte_symbols, halve, pretokens, refuse_others, runs
from lexiloom.llm.checkpoints import shared_dir
from lexiloom.session import ship

CACHE = 600_000
SCHEMA = "doc_id bigint, file_no int, ids_before bigint, n_ids bigint, ids array<int>"
ORC = {"compression": "lz4", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "5000", "orc.stripe.size": str(32 << 20)}


class _Kept(dict):
    """Ids of pre-tokens; the library's model is asked for new ones."""

    def __init__(self, model):
        self.model = model
        self.spell = str.maketrans({chr(b): symbol for symbol, b in byte_symbols().items()})

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.spell))]
        made = self[piece] = pack(f"<{len(ids)}I", *ids)
        return made


class IdEncoder:
    """encode() of a byte-level tokenizers file. Its parts are the file's own: added tokens are
    cut out, the rest is pre-tokenised, and the library's model gives the ids of each pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        refuse_others(json.loads(Path(path).read_text(encoding="utf-8")))
        library = Tokenizer.from_file(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special = {x: pack("<I", library.token_to_id(x)) for x in special}
        self.kept = _Kept(library.model)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.kept) > CACHE:
            halve(self.kept)
        look = self.kept.__getitem__
        if not any(map(text.__contains__, self.special)):
            return b"".join(map(look, pretokens(text)))
        parts = self.split.split(text)
        return b"".join(self.special[p] if i % 2 else b"".join(map(look, pretokens(p))) for i, p in enumerate(parts))


_encoders: dict[str, IdEncoder] = {}
K.KEPT.append(_encoders)


def encoder(path: str) -> IdEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, to: str, end_id: int = 0) -> None:
    """Write the ids of every document to ORC files under `to`, in ascending doc_id order."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.begin(_encoders)
        e, before, number = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in it:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in runs(texts):
                made = [e.encode(t) + end for t in texts[a:b]]
                size = np.array([len(x) // 4 for x in made], np.int64)
                offsets = np.concatenate([[0], np.cumsum(size)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(made), "<u4").view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, number, np.int32)), pa.array(before + offsets[:-1], pa.int64()), pa.array(size), ids], ["doc_id", "file_no", "ids_before", "n_ids", "ids"])
                before += int(offsets[-1])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, SCHEMA).write.options(**ORC).orc(to)


def with_starts(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows (with file_no and ids_before) with start: ids of all documents before. index: the
    files' own rows of file_no, ids_before and n_ids; one row for each file is left of it."""
    totals = index.groupBy("file_no").agg(F.max(F.col("ids_before") + F.col("n_ids")).alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("files_before"))
    return rows.join(F.broadcast(offsets), "file_no").withColumn("start", F.col("files_before") + F.col("ids_before")).drop("files_before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, from the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return with_starts(rows, rows).select("doc_id", "start", "ids")


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of these documents; the filter is pushed to the ORC reader."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit
    integers, from the files. Ids go to Python where they are read, and no further."""
    ship(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(3)
            flat, offsets = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "file_no", "ids_before", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(SCHEMA).orc(path)
    made = rows.select("doc_id", "file_no", "ids_before", "ids").mapInArrow(run, "doc_id bigint, file_no int, ids_before bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(made, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token_ids"
    write(docs, tokenizer, path)
    return digests(spark, path)
