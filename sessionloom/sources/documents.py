"""A sink of text files, one per project and name, that appear whole or not at all."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sessionloom.sources.tail import qualified


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, as (temporary, final) paths."""

    files: list[tuple[str, str]] = field(default_factory=list)


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write to names of their own; the commit renames them, an abort removes them. A repeated task or job leaves the same files."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.root)
        staging, done, current, out = f"{root}/_staging", Written(), None, None
        system.create_dir(staging, recursive=True)
        try:
            for batch in iterator:
                for project, name, line in zip(*(batch.column(c).to_pylist() for c in ("project", "file", "line"))):
                    if (project, name) != current:
                        if out is not None:
                            out.close()
                        current, temporary = (project, name), f"{staging}/{uuid.uuid4().hex}"
                        done.files.append((temporary, f"{root}/project={quote(project, safe='')}/{name}"))
                        out = system.open_output_stream(temporary)
                    out.write(f"{line}\n".encode())
        except BaseException:
            if out is not None:
                out.close()
            self._drop(done)
            raise
        if out is not None:
            out.close()
        return done

    def _drop(self, message: Written) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        for temporary, _ in message.files:
            if system.get_file_info(temporary).type != fs.FileType.NotFound:
                system.delete_file(temporary)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        for temporary, final in (f for m in messages if m is not None for f in m.files):
            system.create_dir(final.rsplit("/", 1)[0], recursive=True)
            system.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message is not None:
                self._drop(message)


class DocumentSink(DataSource):
    """``df.write.format("session_documents")`` with rows ``(project, file, line)``; the lines of a file must come together and in order."""

    @classmethod
    def name(cls) -> str:
        return "session_documents"

    def schema(self) -> str:
        return "project string, file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options["path"])


def write_files(rows: DataFrame, order: list[str | Column], folder: str) -> None:
    """Write ``rows`` with ``project``, ``file`` and ``line`` as files below ``folder``: a file is written by one task as its lines come, in the given order."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSink)
    ordered = rows.repartition("project", "file").sortWithinPartitions("project", "file", *order)
    ordered.select("project", "file", "line").write.format("session_documents").mode("append").save(qualified(spark, folder))


# Ship the sink with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
