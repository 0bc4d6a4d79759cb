"""Reports as files: a batch sink that frames lines as one JSON document, written in parts by all tasks.

`write_report` orders rows over all tasks; each writes the part of its rows, lines with commas between. When all are done the driver, which gets
no lines but only how many there are, gives the parts their names and writes the header, the footer and a comma before each part but
the first one that has lines. The files of the folder, joined in order of their names, are the document. Where a task or the job fails, the
parts are removed and the document is not there.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Part(WriterCommitMessage):
    """What a task tells: its number, its passing file and how many lines are in it."""

    number: int
    passing: str
    lines: int


def _store(folder: str):
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if not folder.startswith("file:/") else folder.replace("file:/", "file:///", 1))
    store.create_dir(place, recursive=True)
    return store, place


class ReportWriter(DataSourceWriter):
    def __init__(self, folder: str, header: str, footer: str, overwrite: bool):
        self.folder, self.header, self.footer, self.overwrite = folder, header, footer, overwrite

    def write(self, iterator: Iterator) -> Part:
        store, place = _store(self.folder)
        passing, lines = posixpath.join(place, f"_{uuid.uuid4().hex}"), 0
        try:
            with store.open_output_stream(passing) as sink:
                for row in iterator:
                    if row[0] is not None:
                        sink.write((",\n" if lines else "").encode() + row[0].encode())
                        lines += 1
        except BaseException:
            store.delete_file(passing)
            raise
        return Part(TaskContext.get().partitionId(), passing, lines)

    def commit(self, messages: list[Part | None]) -> None:
        store, place = _store(self.folder)
        from pyarrow import fs

        old = [x.path for x in store.get_file_info(fs.FileSelector(place)) if not x.base_name.startswith("_")]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.folder)

        def put(name: str, text: str) -> None:
            with store.open_output_stream(posixpath.join(place, name)) as sink:
                sink.write(text.encode())

        for path in old:
            store.delete_file(path)
        put("00000000-a-header.json", self.header + "\n")
        any_lines = False
        for k, part in enumerate(sorted((m for m in messages if m is not None), key=lambda m: m.number), 1):
            if part.lines == 0:
                store.delete_file(part.passing)
                continue
            if any_lines:
                put(f"{k:08d}-a-comma.json", ",\n")
            store.move(part.passing, posixpath.join(place, f"{k:08d}-b-lines.json"))
            any_lines = True
        put("99999999-footer.json", "\n" + self.footer)

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = _store(self.folder)
        for part in messages:
            if part is not None:
                store.delete_file(part.passing)


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "framed_lines"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["folder"], self.options.get("header", "["), self.options.get("footer", "]"), overwrite)


def write_report(rows: DataFrame, folder: str, order: list[str], header: str = "[", footer: str = "]", overwrite: bool = False) -> None:
    """Write `rows` (value, a JSON text each; null ones are left out) as the document header, values with commas between, footer. Equal rows all stay; without rows the document is header and footer."""
    spark = rows.sparkSession
    spark.dataSource.register(ReportSource)
    ordered = rows.orderBy(*order).select("value")
    ordered.write.format("framed_lines").option("folder", folder).option("header", header).option("footer", footer).mode("overwrite" if overwrite else "append").save()


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """(value): the lines of a document of `write_report`, without header, footer and commas."""
    lines = spark.read.text(folder, pathGlobFilter="*-b-lines.json")
    return lines.select(F.regexp_replace("value", ",$", "").alias("value"))


def report_text(folder: str) -> str:
    """The whole document, for small ones."""
    from pyarrow import fs

    store, place = _store(folder)
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(place)) if not x.base_name.startswith("_"))
    return "".join(store.open_input_stream(n).read().decode() for n in names)


def check_report(folder: str) -> dict | list:
    return json.loads(report_text(folder))
