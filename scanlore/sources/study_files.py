"""A sink of CSV files, one for each study, many to a task, each written in order and shown only when the whole job has ended.

A task writes its files below a staging folder; the commit moves each task's
folder into place and removes the staging folder, with whatever failed or
repeated attempts have left there. A job that is aborted leaves nothing.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .ranges import file_system

STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    folder: str
    files: int


class StudyFiles(DataSource):
    """``df.write.format("study_csv")``: rows with study_file, place and the fields; options path and header (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "study_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.names, overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), json.loads(options["header"]), overwrite
        self.fields = [c for c in names if c not in ("study_file", "place")]
        self.job = uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{self.path}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        folder = uuid.uuid4().hex
        system, inner = file_system(f"{self._staging()}/{folder}")
        name, out, count = None, None, 0
        try:
            for row in iterator:
                if row["study_file"] != name:
                    if out is not None:
                        out.close()
                    else:
                        system.create_dir(inner, recursive=True)
                    name, count = row["study_file"], count + 1
                    out = system.open_output_stream(f"{inner}/{name}")
                    out.write(self._line(self.header))
                out.write(self._line([row[c] for c in self.fields]))
                if row["place"] == 0:  # the section of the patient ends with an empty line
                    out.write(self._line([]))
        finally:
            if out is not None:
                out.close()
        return Written(folder, count)

    @staticmethod
    def _line(values: list[str]) -> bytes:
        line = io.StringIO()
        csv.writer(line).writerow(values)
        return line.getvalue().encode()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, staged = file_system(self._staging())
        _, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(inner)):
                if x.base_name.startswith("part-"):
                    system.delete_dir(x.path)
        for m in messages:
            if isinstance(m, Written) and m.files:
                system.move(f"{staged}/{m.folder}", f"{inner}/part-{m.folder}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, staged = file_system(self._staging())
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)
        above = staged.rpartition("/")[0]
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


def write_studies(text: DataFrame, header: list[str], path: str, mode: str = "append") -> None:
    """Write rows of (study, place, fields) as ``<study>.csv``, a study's rows in the order of their places."""
    text.sparkSession.dataSource.register(StudyFiles)
    named = text.withColumn("study_file", F.concat(F.regexp_replace("study", r"[^A-Za-z0-9._-]+", "_"), F.lit(".csv"))).drop("study")
    dealt = named.repartition("study_file").sortWithinPartitions("study_file", "place")
    dealt.write.format("study_csv").option("path", path).option("header", json.dumps(header)).mode(mode).save()
