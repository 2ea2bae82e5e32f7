"""A sink that writes a file for each row.

Every file is written under `_temporary` and takes its name when it is whole, so a reader
never sees half a file. A task that runs again, or a job that is killed and repeated, puts the
same files in the same places. `_SUCCESS` is taken away when a job begins and written, with the
number of files, when all tasks are done. The driver gets one small message a task.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corpusloom.operators.rank import first_by_key

#: Files that a task writes, about.
FILES_A_TASK = 20_000


@dataclass
class Written(WriterCommitMessage):
    files: int
    kept: int


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def checked(name: str | None) -> str:
    """A relative file name that stays under the folder; anything else is an error."""
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a file name under a folder: {name!r}")
    return "/".join(parts)


def placed(system: fs.FileSystem, part: str, target: str, keep: bool) -> bool:
    """Gives a whole file its name; keep: unless there is one, then false. A local file system lets
    only one rename between folders pass at a time, so there a file is linked, which tasks do
    side by side and which fails where a file is."""
    if not isinstance(system, fs.LocalFileSystem):
        system.move(part, target)
        return True
    try:
        os.link(part, target)
    except FileExistsError:
        if not keep:
            os.replace(part, target)
            return True
        os.unlink(part)
        return False
    except OSError:  # no links there
        os.replace(part, target)
        return True
    os.unlink(part)
    return True


class RowFiles(DataSource):
    """Options: path, and existing: `replace` (default) or `keep` files that are there."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema: StructType, overwrite: bool) -> RowFilesWriter:
        if overwrite:
            raise ValueError("row_files only appends: files of the same name are replaced or kept")
        return RowFilesWriter(self.options["path"], self.options.get("existing", "replace") == "keep")


class RowFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, keep: bool):
        self.path, self.keep, self.job = path.rstrip("/"), keep, uuid.uuid4().hex
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_SUCCESS").type != fs.FileType.NotFound:
            system.delete_file(f"{root}/_SUCCESS")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = filesystem(self.path)
        staged = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}"  # a folder of its own: tasks wait for each other in a shared one
        system.create_dir(staged, recursive=True)
        made, done = set(), Written(0, 0)
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                target = f"{root}/{checked(name.as_py())}"
                if self.keep and system.get_file_info(target).type != fs.FileType.NotFound:
                    done.kept += 1
                    continue
                folder = target.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{staged}/{done.files + done.kept}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer() or b"")
                if placed(system, part, target, self.keep):
                    done.files += 1
                else:
                    done.kept += 1
        return done

    def _clear(self) -> tuple[fs.FileSystem, str]:
        system, root = filesystem(self.path)
        if system.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary")
        return system, root

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._clear()
        system.create_dir(root, recursive=True)
        told = [m for m in messages if m]
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in told), "kept": sum(m.kept for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


def files_told(folder: str) -> int:
    """Files that the last job put or found in the folder, by its `_SUCCESS`; 0 without one."""
    system, root = filesystem(folder.rstrip("/"))
    if system.get_file_info(f"{root}/_SUCCESS").type == fs.FileType.NotFound:
        return 0
    with system.open_input_stream(f"{root}/_SUCCESS") as f:
        return sum(json.loads(f.read()).values())


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content", keep: bool = False, unique: bool = False) -> None:
    """Writes each row's content (text or bytes; null: an empty file) as a file of that name
    under the folder, which all executors share. Of rows with one name the first by content;
    unique: the caller knows that names don't repeat. keep: files that are there stay as they
    are. An empty table writes `_SUCCESS` alone. Rows are counted and dealt to tasks of FILES_A_TASK
    files: what takes time is the number of files, which Spark, going by bytes, leaves in few tasks."""
    files.sparkSession.dataSource.register(RowFiles)
    rows = files.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    rows = rows.repartition(max(1, -(-files.count() // FILES_A_TASK)), "name")
    if not unique:
        rows = first_by_key(rows, [F.col("name")], [F.col("content")])
    rows.write.format("row_files").option("existing", "keep" if keep else "replace").mode("append").save(folder)
