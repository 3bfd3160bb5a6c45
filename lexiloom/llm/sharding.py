"""Shards as runs of a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS cells by its quantiles over all rows, the cells of a row give its index
on the curve, and rows are ordered by (index, fingerprint of the text, doc_id). The order is cut into runs of
equal row counts (law `rows`: counts differ by at most one). Files that hold a run have narrow ranges in
every dimension at once, so filters on any of them skip files (`manifest`, `prune`).

A label is quantised as a number that keeps its order: LABEL_BYTES bytes from where the least and the greatest
label part. Quantiles are kept with their repetitions, so a cell says how large a part of the rows comes before:
frequent labels take as much of the curve's square as of the table, and labels that agree in those bytes share a cell.

Sizes and fingerprints are read from the texts once and written, the curve is computed once from them. The global
rank comes from a range partitioning by the curve index, a count for each partition, and a row's place in its
partition; no task and not the driver holds more than counts.

Groups of equal texts: rows of one text and equal labels have one index and stand side by side, so they are in one
shard or, where a run ends among them, in shards that follow each other. Rows of one text under other labels go where
their labels say.

Defined results: a null dimension goes to cell 0; a null text has size 1 and the crc32 of the empty
string; rows that are equal in all of this are ordered by their place; an empty table gives an empty
result; extra columns don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.checkpoints import cut
from lexiloom.session import ship

BITS = 6
SHARDS = 8
LABEL_BYTES = 7


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of points with coordinates cells[i] (one row each).
    The coordinates are brought to the transposed form of the index bit by bit from the top,
    for all points at once, and then read across the dimensions."""
    x = [c.astype(np.uint64) for c in cells]
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        below = q - one
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[d]
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        carry = np.where((x[dims - 1] & q) != 0, carry ^ (q - one), carry)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << one | ((x[d] ^ carry) >> np.uint64(level)) & one
    return out.astype(np.int64)


def label_number(c: Column, skip: int) -> Column:
    """LABEL_BYTES bytes of a label after the first `skip`, as a number in the order of the labels; -1 for null."""
    part = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, LABEL_BYTES)), 2 * LABEL_BYTES, "0")
    return F.coalesce(F.conv(part, 16, 10).cast("long"), F.lit(-1).cast("long"))


def shared_bytes(low: str | None, high: str | None) -> int:
    """How many bytes all labels between the two have in common at their beginning."""
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def cells(values: np.ndarray, bounds: list[int], bits: int = BITS) -> np.ndarray:
    """How many of the quantiles are below each value."""
    return np.searchsorted(np.array(bounds, np.int64), values, side="left").clip(0, (1 << bits) - 1)


def hilbert_order(docs: DataFrame, labels: tuple[str, ...] = ("lang", "source"), numbers: tuple[str, ...] = ("size",), bits: int = BITS) -> DataFrame:
    """docs with `curve`. docs must have the columns named; it is read three times, for the labels' range, the
    quantiles (2**bits - 1 numbers a dimension) and the curve."""
    ship(docs.sparkSession)
    ends = docs.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(labels) for k, f in (("a", F.min), ("b", F.max)))).first()
    dims = [label_number(F.col(c), shared_bytes(ends[f"a{i}"], ends[f"b{i}"])) for i, c in enumerate(labels)] + [F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")) for c in numbers]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = docs.agg(*(F.percentile_approx(d, steps, 10_000).alias(f"q{i}") for i, d in enumerate(dims))).first()
    bounds = [sorted(found[f"q{i}"] or []) for i in range(len(dims))]

    @F.pandas_udf("long")
    def index(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in it:
            yield pd.Series(hilbert_index(np.stack([cells(c.to_numpy(), b, bits) for c, b in zip(columns, bounds, strict=True)]), bits))

    return docs.withColumn("curve", index(*dims))


def ranked(docs: DataFrame, *order: str) -> DataFrame:
    """docs with `rank` from 0 in the given order, and `total`; written once."""
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = cut(dealt, "ordered")
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    before, at = {}, 0
    for r in sorted(counts, key=lambda r: r.part):
        before[r.part], at = at, at + r.n
    offsets = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").select(*docs.columns, (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"), F.lit(at).cast("long").alias("total"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (bytes of the text plus 1), text_crc32 and a fingerprint; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("print"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of sizes(docs) with curve, shard and slot."""
    rows = ranked(cut(hilbert_order(cut(sizes(docs), "sizes")), "curve"), "curve", "print", "doc_id")
    shard = F.expr(f"((rank + 1) * {shards} - 1) div total")
    first = F.expr(f"(shard * total) div {shards}")  # the least rank of the shard
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long"))


def write_shards(docs: DataFrame, to: str, shards: int = SHARDS, files_per_shard: int = 4) -> DataFrame:
    """Write whole documents as Parquet, one run of the curve a file, and return the manifest."""
    placed = assign(docs, shards).select("doc_id", "print", "lang", "source", "curve", "shard", "slot", "rank", "total", "size")
    run = F.expr(f"((rank + 1) * {shards * files_per_shard} - 1) div total").cast("int")
    whole = docs.withColumn("print", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    # equal rows have equal keys; numbering them on both sides keeps each once
    from pyspark.sql import Window

    key = ("doc_id", "print", "lang", "source")
    w = Window.partitionBy(*key)
    one, other = placed.withColumn("copy", F.row_number().over(w.orderBy("rank"))), whole.withColumn("copy", F.row_number().over(w.orderBy(F.monotonically_increasing_id())))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "copy")]
    joined = other.alias("a").join(one.withColumn("run", run).alias("b"), same).select(*(f"a.{c}" for c in docs.columns), *(f"b.{c}" for c in ("curve", "shard", "slot", "size", "run") if c not in docs.columns))
    joined.repartitionByRange(shards * files_per_shard, "run").sortWithinPartitions("run", "slot").write.partitionBy("shard").parquet(to)
    return manifest(docs.sparkSession.read.parquet(to))


def manifest(written: DataFrame, dims: tuple[str, ...] = ("lang", "source", "size", "doc_id")) -> DataFrame:
    """A row for each file: its path, rows and the least and greatest value of each dimension."""
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{k}_{c}") for c in dims for k, f in (("min", F.min), ("max", F.max))))


def prune(files: DataFrame, **ranges: tuple) -> DataFrame:
    """Files of a manifest that can hold rows with every dimension inside its (low, high)."""
    out = files
    for c, (low, high) in ranges.items():
        out = out.where((F.col(f"max_{c}") >= F.lit(low)) & (F.col(f"min_{c}") <= F.lit(high)))
    return out


def query(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
