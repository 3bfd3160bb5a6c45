"""A folder of notes with the commands of a note application, each as one DataFrame job.

A note is a Markdown file under `root`/files. The note table beside it is in buckets of ids: a command writes the buckets of the
notes that it changes and then the table's next state, so a reader never meets half a change, and of two writers
at once the second gets a Conflict. The search index follows the table: a search first brings it up to date with what changed
since, which is nothing for most. Loading reads the file, which may have been edited elsewhere. Trashed files go to
files/.trash. Personal words and undone corrections are tables too, one folder for each version.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexiloom.operators import correct, search, store
from lexiloom.operators.segments import SegmentIndex
from lexiloom.session import ship
from lexiloom.sources import export, notes as note_files
from lexiloom.sources.buckets import BucketTable


def _now() -> int:
    return int(time.time())


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    resources: correct.Resources
    settings: correct.Settings = field(default_factory=correct.Settings)

    def __post_init__(self) -> None:
        ship(self.spark)
        self.table = BucketTable(self.spark, f"{self.root}/notes", store.SCHEMA)
        self.index = SegmentIndex(self.spark, f"{self.root}/index")

    # --- state ---------------------------------------------------------------------------
    def _read(self, name: str, schema: str) -> DataFrame:
        """The newest version of a table, or no rows."""
        try:
            all_ = self.spark.read.schema(f"{schema}, version bigint").parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        newest = all_.select("version").distinct().agg(F.max("version").alias("v")).first().v  # from folder names
        return all_.where(F.col("version") == newest).drop("version") if newest is not None else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}/version={time.time_ns()}")

    def notes(self) -> DataFrame:
        return self.table.read()

    def _note(self, note_id: str) -> DataFrame:
        """The row of a note, from its bucket."""
        one = self.spark.createDataFrame([(note_id,)], "id string")
        return self.table.read({one.select(self.table.bucket_of()).first()[0]}).where(F.col("id") == note_id)

    def user_words(self) -> DataFrame:
        return self._read("user_words", "word string, added_at bigint")

    def undo(self) -> DataFrame:
        return self._read("undo", "from_word string, to_word string, count bigint")

    def _resources(self) -> correct.Resources:
        return replace(self.resources, user_words=self.user_words().select("word"), undo=self.undo())

    # --- correction -----------------------------------------------------------------------
    def _one(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(0, text)], "doc_id bigint, text string")

    def check_text(self, text: str) -> DataFrame:
        return correct.check(self._one(text), self._resources(), self.settings).drop("doc_id").orderBy("pos")

    def fix_all(self, text: str) -> str:
        return correct.fix_all(self._one(text), self._resources(), self.settings).first().corrected

    def corrector_settings(self) -> correct.Settings:
        return self.settings

    def set_corrector_settings(self, **changes) -> correct.Settings:
        self.settings = replace(self.settings, **changes)
        return self.settings

    def aggressiveness_options(self) -> list[dict[str, str | float]]:
        return [{"name": n, "auto": correct.AUTO_THRESHOLD[n], "flag": correct.FLAG_THRESHOLD[n]} for n in correct.AUTO_THRESHOLD]

    def dict_status(self) -> dict[str, int | bool]:
        pairs = self.resources.pairs.count() if self.resources.pairs is not None else 0
        return {**{f"{n}_words": c for n, c in self.resources.sizes.items()}, "pairs": pairs, "has_context": pairs > 0, "ready": self.resources.ready(self.settings)}

    def add_to_user_dict(self, word: str) -> None:
        new = self.spark.createDataFrame([(word.lower(), _now())], "word string, added_at bigint")
        self._write("user_words", self.user_words().unionByName(new).groupBy("word").agg(F.min("added_at").alias("added_at")))

    def record_undo(self, from_word: str, to_word: str) -> None:
        new = self.spark.createDataFrame([(from_word.lower(), to_word.lower(), 1)], "from_word string, to_word string, count bigint")
        self._write("undo", self.undo().unionByName(new).groupBy("from_word", "to_word").agg(F.sum("count").alias("count")))

    # --- notes ------------------------------------------------------------------------------
    def list_notes(self, limit: int = store.LIST_LIMIT) -> DataFrame:
        return store.listing(self.notes(), limit)

    def _file(self, path: str) -> dict | None:
        """What the note's file says; None without a file."""
        try:
            lines = self.spark.read.text(f"{self.root}/files/{path}", wholetext=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        found = note_files.parse(lines.select(F.lit(path).alias("path"), F.col("value").alias("content"), F.lit(0).cast("bigint").alias("modified"))).first()
        return found and found.asDict()

    def load_note(self, note_id: str) -> dict | None:
        """The note as its file has it, counted as opened; None if there is none or it is in the trash."""
        row = store.live(self._note(note_id)).first()
        on_disk = row and self._file(row.path)
        if on_disk is None:
            return None
        opens = self.spark.createDataFrame([(note_id, _now())], "id string, ts bigint")
        self.table.change(opens, lambda old: store.touched(old, opens))
        return row.asDict() | on_disk | {"id": note_id}

    def create_note(self, body: str) -> str:
        new = note_files.rendered(store.created(self.spark.createDataFrame([(body,)], "body string"), F.lit(_now()))).drop("content")
        row = new.first()  # one row; its id is made once, here
        made = self.spark.createDataFrame([row], new.schema).select(*store_columns())
        self._put(made)
        self.table.change(made, lambda old: store.upsert(old, made))
        return row.id

    def _put(self, notes: DataFrame) -> None:
        """Write the notes' files; each is moved into place whole."""
        note_files.write_files(note_files.rendered(notes).select("path", "content"), f"{self.root}/files")

    def save_note(self, note: dict) -> None:
        """Write the note's file, under the name that it has had from the start, and index it."""
        one = self.spark.createDataFrame([tuple(note.get(c) for c in store_columns())], store.SCHEMA)
        had = self._note(note["id"]).select("path").first()
        ready = store.saved(one, F.lit(_now()))
        ready = ready.withColumn("path", F.lit(had.path) if had else F.coalesce("path", store.file_name(F.col("title"), F.col("id"))))
        new = note_files.rendered(ready).drop("content").select(*store_columns())
        self._put(new)
        self.table.change(new, lambda old: store.upsert(old, new))

    def trash_note(self, note_id: str) -> None:
        """Mark the note as trashed and move its file, if it is there, to files/.trash."""
        had = self._note(note_id).select("path").first()
        if had is not None:
            note_files.move_file(f"{self.root}/files", had.path, f".trash/{had.path.rpartition('/')[2]}")
        gone = self.spark.createDataFrame([(note_id,)], "id string")
        self.table.change(gone, lambda old: store.trash(old, gone, F.lit(_now())))

    def reindex(self, folder: str) -> int:
        """The note table made anew from Markdown files."""
        parsed = note_files.parse(note_files.scan(self.spark, folder))
        new = store.rebuilt(note_files.rendered(parsed).drop("content")).select(*store_columns())
        self.table.replace(new)
        return self.notes().count()

    def snapshot(self) -> None:
        store.versions(self.notes(), F.lit(_now())).write.mode("append").parquet(f"{self.root}/versions")

    def search_notes(self, text: str, limit: int = search.LIMIT) -> DataFrame:
        """Search for the text and, if the corrector would change it, for its corrected form too, in the index."""
        one = self._one(text)
        fixed = correct.apply(one, correct.check(one, self._resources(), self.settings)).first().corrected
        self.index.refresh(self.table)
        return search.search_index(self.index.index(self.notes()), text, (fixed,) if fixed != text else (), limit)

    def stats(self) -> dict[str, int]:
        return {"notes": store.count_live(self.notes()).first().n}

    def export_note(self, note_id: str, format_name: str, to: str) -> int:
        return note_files.write_files(export.exported(store.live(self._note(note_id)), format_name), to)


def store_columns() -> list[str]:
    return [c.strip().split()[0] for c in store.SCHEMA.split(",")]
