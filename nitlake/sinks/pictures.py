"""Pictures written by Spark's data source interface: staged by tasks, put in place by the commit."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.codes import HDR_CODES, SDR_CODES
from ..sources.png import opened
from .png import encode_png

NEEDED = ("name", "height", "width", "r", "g", "b")
#: Files that a commit moves at the same time.
MOVES = 16
STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: (staged file, name below the folder) of each picture."""

    files: list[tuple[str, str]]


class _Writing:
    """Both writers. Tasks write below ``_staged-<job>/<attempt>``; a picture comes into its place when the
    job (or the micro-batch) is committed. A task that runs twice has two folders and one message."""

    def __init__(self, folder: str, schema: StructType, depth: int, tag_pq: bool, overwrite: bool = False):
        missing = [name for name in NEEDED if name not in schema.names]
        if missing:
            raise ValueError(f"pictures need the columns {missing}")
        if depth not in (8, 16):
            raise ValueError("depth must be 8 or 16")
        self.folder, self.depth, self.tag_pq, self.overwrite = folder.rstrip("/"), depth, tag_pq, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, root = opened(self.folder)
        place = f"{root}/{STAGED}-{self.job}/{uuid.uuid4().hex}"
        files, top = [], HDR_CODES if self.depth == 16 else SDR_CODES
        for batch in iterator:
            if batch.num_rows and not files:
                system.create_dir(place, recursive=True)
            held = [batch.column(name) for name in NEEDED]
            for row in range(batch.num_rows):
                name, height, width, *planes = (column[row] for column in held)
                light = np.stack([plane.values.to_numpy(zero_copy_only=False) for plane in planes]).astype(float)
                codes = np.rint(np.clip(light, 0, 1) * top).reshape(3, height.as_py(), width.as_py())
                files.append((f"{place}/{len(files)}.png", name.as_py()))
                with system.open_output_stream(files[-1][0]) as out:
                    out.write(encode_png(codes, self.depth, self.tag_pq))
        return Staged(files)

    def _commit(self, messages: list[Staged | None]) -> None:
        files = [pair for message in messages if message is not None for pair in message.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            raise ValueError("two pictures have one name")
        system, root = opened(self.folder)
        if self.overwrite:
            self._clear(system, root, names)
        for parent in {f"{root}/{name}".rpartition("/")[0] for name in names}:
            system.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda pair: system.move(pair[0], f"{root}/{pair[1]}"), files))
        self._forget(messages)

    @staticmethod
    def _clear(system, root: str, names: set[str]) -> None:
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            below = info.path.removeprefix(root).lstrip("/")
            if info.is_file and below.endswith(".png") and not below.startswith(STAGED) and below not in names:
                system.delete_file(info.path)

    def _forget(self, messages: list[Staged | None]) -> None:
        """Remove what the job of these messages has staged, leftovers of lost tasks included. A stream's
        commits run in a process of their own, which knows its tasks by their messages only."""
        from pyarrow import fs

        system, root = opened(self.folder)
        places = {f"{root}/{STAGED}-{self.job}"}
        places |= {staged.rsplit("/", 2)[0] for message in messages if message is not None for staged, _ in message.files}
        for place in places:
            if system.get_file_info(place).type != fs.FileType.NotFound:
                system.delete_dir(place)


class PictureWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self._commit(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        self._forget(messages)


class PictureStreamWriter(_Writing, DataSourceStreamArrowWriter):
    """A micro-batch that runs again after a failure writes the same names once more."""

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self._commit(messages)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._forget(messages)
