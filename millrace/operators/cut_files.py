"""Many files of encoded rows, written by the tasks themselves."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass(frozen=True)
class Folder(WriterCommitMessage):
    """Where one task's files lie; None for a task without rows."""

    path: str | None


class CutFilesWriter(DataSourceArrowWriter):
    """Writes rows ``(file name, line)``, those of one file next to each other in one task.

    A task fills a folder of its own below a hidden one, and commit renames the folders of the tasks that Spark counts: a
    rename per task, not per file, and what a failed or repeated task wrote is never read.
    """

    def __init__(self, options: Mapping[str, str]):
        self.root, self.suffix = options["root"], options["suffix"]
        self.end = options["end"].encode()
        self.head = options["head"].encode() + self.end if "head" in options else b""
        self.staging = os.path.join(self.root, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Folder:
        folder, current, out = os.path.join(self.staging, uuid.uuid4().hex), None, None
        try:
            for batch in iterator:
                names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for name, rows in groupby(zip(names, lines), itemgetter(0)):
                    if name != current:
                        if out:
                            out.close()
                        else:
                            os.makedirs(folder)
                        out, current = open(os.path.join(folder, name + self.suffix), "xb", 65536), name
                        out.write(self.head)
                    for _, line in rows:
                        out.write(line)
                        out.write(self.end)
        finally:
            if out:
                out.close()
        return Folder(folder if out else None)

    def commit(self, messages: Sequence[Folder | None]) -> None:
        os.makedirs(self.root, exist_ok=True)
        for part, folder in enumerate(m.path for m in messages if m and m.path):
            os.rename(folder, os.path.join(self.root, f"_part={part:05d}"))
        shutil.rmtree(self.staging, ignore_errors=True)
        open(os.path.join(self.root, "_SUCCESS"), "wb").close()

    def abort(self, messages: Sequence[Folder | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class CutFiles(DataSource):
    """Output of encoded rows to many files of a file system that every executor has mounted."""

    @classmethod
    def name(cls) -> str:
        return "cut_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CutFilesWriter(self.options)


def write(lines: DataFrame, root: str, suffix: str, end: str, head: str | None) -> None:
    """Write rows ``(file name, line as binary)`` below ``root``; each file begins with ``head`` if there is one."""
    lines.sparkSession.dataSource.register(CutFiles)
    name = lines.columns[0]
    heads = {} if head is None else {"head": head}
    (lines.repartition(name).sortWithinPartitions(name).write.format("cut_files").mode("append")
     .options(root=root, suffix=suffix, end=end, **heads).save())
