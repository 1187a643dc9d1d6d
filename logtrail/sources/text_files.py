"""A sink of named text files: one for each row, all put in place together when the last task is done."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from logtrail.sources.files import opened


#: Times that a folder is tried to be removed, a tenth of a second apart.
TRIES = 20


@dataclass
class Written(WriterCommitMessage):
    files: int


class Writer(DataSourceWriter):
    """Tasks write into a hidden folder beside the target, each file under its own name, so that a task that is tried
    again writes over what it left; the folder takes the target's place at commit and is removed at abort.

    Spark may commit or abort while tasks that it has given up are still writing. A mark beside the folder says that the
    write goes on: it is made before the tasks begin and goes before the folder does. A task that has written a file and
    finds no mark removes what is there; one that found it wrote before the folder was removed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.mark = folder.rstrip("/"), uuid.uuid4().hex
        files, _, draft, _ = self._paths()
        files.create_dir(draft, recursive=True)
        files.open_output_stream(f"{draft}-open").close()

    def _paths(self) -> tuple[pafs.FileSystem, str, str, str]:
        files, target = opened(self.folder)
        above, _, name = target.rstrip("/").rpartition("/")
        return files, target, f"{above}/.{name}-{self.mark}", f"{above}/.{name}-{self.mark}-before"

    def write(self, rows: Iterator) -> Written:
        files, _, draft, _ = self._paths()
        self._go_on(files, draft)
        n = 0
        for name, text in rows:
            if not name or "/" in name:
                raise ValueError(f"not a name of a file: {name}")
            with files.open_output_stream(f"{draft}/{name}") as out:
                out.write((text or "").encode())
            self._go_on(files, draft)
            n += 1
        return Written(n)

    def _go_on(self, files: pafs.FileSystem, draft: str) -> None:
        if files.get_file_info(f"{draft}-open").type == pafs.FileType.NotFound:
            self._remove(files, draft)
            raise RuntimeError("the write has ended")

    def _remove(self, files: pafs.FileSystem, draft: str) -> None:
        """The mark, then the folder: again if a task wrote a file, or removed it too, meanwhile."""
        if files.get_file_info(f"{draft}-open").type != pafs.FileType.NotFound:
            files.delete_file(f"{draft}-open")
        for left in reversed(range(TRIES)):
            if files.get_file_info(draft).type == pafs.FileType.NotFound:
                return
            try:
                files.delete_dir(draft)
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)

    def commit(self, messages: list[Written | None]) -> None:
        files, target, draft, before = self._paths()
        found, told = len(files.get_file_info(pafs.FileSelector(draft, allow_not_found=True))), sum(m.files for m in messages if m)
        if found != told:
            self._remove(files, draft)
            raise ValueError(f"{told} texts for {found} names of files")
        files.create_dir(draft, recursive=True)  # a store without folders has none for no files
        there = files.get_file_info(target).type != pafs.FileType.NotFound
        if there:
            files.move(target, before)
        files.move(draft, target)
        self._remove(files, draft)
        if there:
            files.delete_dir(before)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, draft, _ = self._paths()
        self._remove(files, draft)


class TextFiles(DataSource):
    """`df.write.format("text_files").mode("overwrite").save(folder)` for columns name and text, after registering."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if not overwrite:
            raise ValueError("a folder of files is replaced as a whole: use the mode overwrite")
        if schema.names != ["name", "text"]:
            raise ValueError("columns name and text are written")
        return Writer(self.options["path"])


def write_files(texts: DataFrame, folder: str) -> None:
    """Replaces the folder by a file for each row (name, text); an error, and the folder as it was, if a name comes twice."""
    texts.sparkSession.dataSource.register(TextFiles)
    texts.select("name", "text").write.format("text_files").mode("overwrite").save(folder)


def incident_file(suffix: str) -> Column:
    """The name of an incident's file, by scope and number."""
    return F.concat(F.lit("incident-"), F.url_encode(F.coalesce("scope", F.lit(""))), F.lit("-"), F.col("inc_idx").cast("string"), F.lit(suffix))
