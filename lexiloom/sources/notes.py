"""Markdown notes as rows: recursive scan, front matter, rendering, one file for each note."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.store import content_hash
from lexiloom.session import ship

KEYS = ("id", "title", "tags", "created", "updated", "pinned", "archived", "title_manual")


def relative_path(path: Column, root: str) -> Column:
    """Path below root, with forward slashes."""
    bare = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(bare, rf"^(?:[a-z0-9]+:/+)?/?\Q{root.replace(chr(92), '/').strip('/')}\E/", "")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modified) of every .md file below root. Files and folders whose names begin
    with a dot are left out; so, by the reader's own rule, are those that begin with an underscore."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = files.select(relative_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), root.split("://")[-1]).alias("path"), F.col("value").alias("content"), F.unix_timestamp("_metadata.file_modification_time").alias("modified"))
    return rows.where(~F.col("path").rlike(r"(^|/)\."))


def split_front_matter(content: Column) -> Column:
    """struct(header, body): without a closed header all of it is body. The header ends at the first line
    after the first one that is --- beside white space."""
    bare = F.regexp_replace(content, r"\A\x{feff}", "")
    opened = bare.startswith("---") & bare.contains("\n")
    rest = F.when(opened, F.substring(bare, F.instr(bare, "\n") + 1, F.length(bare)))
    # the closing line and what is before and after it: a split at the first one
    parts = F.split(rest, r"(?:\A|(?<=\n))[ \t\r]*+---[ \t\r]*+(?:\n|\z)", 2)
    closed = F.coalesce(opened & (F.size(parts) == 2), F.lit(False))
    body = F.regexp_replace(parts[1], r"\A\n", "")
    return F.struct(F.when(closed, parts[0]).otherwise("").alias("header"), F.when(closed, body).otherwise(bare).alias("body"))


def parse(files: DataFrame, fallback_id: Column | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    """Notes of (path, content, modified): unknown keys are skipped, broken values fall back. kept: further columns of
    files that stay beside the note."""
    fallback_id = F.regexp_extract("path", r"([^/]*?)(?:\.md)?$", 1) if fallback_id is None else fallback_id
    rows = files.withColumn("_f", split_front_matter(F.col("content")))
    lines = F.filter(F.transform(F.split("_f.header", "\n"), T.trimmed), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(T.trimmed(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"), T.trimmed(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    rows = rows.withColumn("_p", pairs)
    last = lambda key: F.try_element_at(F.transform(F.filter("_p", lambda x: (x["k"] == key) & ((x["v"] != "") if key == "id" else F.lit(True))), lambda x: x["v"]), F.lit(-1))
    flag = lambda key: F.coalesce(T.parse_bool(last(key)), F.lit(False))
    created = F.coalesce(T.parse_time(last("created")), F.col("modified"))
    updated = F.coalesce(T.parse_time(last("updated")), F.col("modified"))
    title = F.coalesce(T.unescape_scalar(last("title")), F.lit(""))
    return rows.select(
        "path",
        F.coalesce(T.unquote(last("id")), fallback_id).alias("id"),
        F.when(title == "", T.derive_title(F.col("_f.body"), T.TITLE_FALLBACK)).otherwise(title).alias("title"),
        F.col("_f.body").alias("body"),
        F.coalesce(T.parse_tags(last("tags")), F.array().cast("array<string>")).alias("tags"),
        created.alias("created_at"),
        F.greatest(created, updated).alias("updated_at"),
        flag("pinned").alias("pinned"),
        flag("archived").alias("archived"),
        (flag("title_manual") & (title != "")).alias("title_manual"),
        *kept,
    )


def render() -> Column:
    """The file of a note row; parse() reads it back. Tags and flags are written only where set."""
    line = lambda key, value, on=F.lit(True): F.when(on, F.concat(F.lit(f"{key}: "), value, F.lit("\n"))).otherwise("")  # noqa: E731, B008
    yes = F.lit("true")
    return F.concat(
        F.lit("---\n"), line("id", F.col("id")), line("title", T.escape_scalar(F.col("title"))), line("tags", F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")), F.size("tags") > 0),
        line("created", T.format_time(F.col("created_at"))), line("updated", T.format_time(F.col("updated_at"))), line("pinned", yes, F.col("pinned")), line("archived", yes, F.col("archived")),
        line("title_manual", yes, F.col("title_manual")), F.lit("---\n"), F.col("body"),
    )


def rendered(notes: DataFrame) -> DataFrame:
    """notes with content (the file) and content_hash."""
    ship(notes.sparkSession)
    return notes.withColumn("content", render()).withColumn("content_hash", content_hash("content"))


def write_files(files: DataFrame, root: str) -> int:
    """Write (path, content: binary) as one file each below root, a URI or path that every executor
    can reach. Each file is written under another name and moved into place, so a task that is run
    again leaves whole files. Two rows with one path are an error, and nothing is written. Returns how many."""
    ship(files.sparkSession)
    twice = files.groupBy("path").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} files would be written to {twice.path}")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
        made: set[str] = set()
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = f"{base.rstrip('/')}/{path}"
                folder = to.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as f:
                    f.write(content)
                fs.move(draft, to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def move_file(root: str, path: str, to: str) -> bool:
    """Move one file below root; False if it isn't there."""
    from pyarrow.fs import FileSystem, FileType

    fs, base = FileSystem.from_uri(root if "://" in root else f"file://{root}")
    if fs.get_file_info(f"{base}/{path}").type == FileType.NotFound:
        return False
    fs.create_dir(f"{base}/{to}".rpartition("/")[0], recursive=True)
    fs.move(f"{base}/{path}", f"{base}/{to}")
    return True


def write_table(notes: DataFrame, to: str) -> None:
    """The note table as Parquet, sorted so that lists read few row groups."""
    notes.repartitionByRange(F.col("updated_at").desc()).sortWithinPartitions(F.col("updated_at").desc()).write.mode("overwrite").parquet(to)
