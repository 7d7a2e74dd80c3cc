"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as pafs


class Writer:
    """A file under a temporary name that ``commit`` moves to its own name; a
    repeated task writes the same file again."""

    def __init__(self, base: str, name: str):
        self.fs, self.base = pafs.FileSystem.from_uri(base)
        self.name = name
        self.temp = f"{self.base}/_temporary/{uuid.uuid4().hex}-{name}"
        self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.bytes = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, f"{self.base}/{self.name}")


def open_file(base: str, name: str):
    fs, path = pafs.FileSystem.from_uri(base)
    return fs.open_input_file(f"{path}/{name}")


def mapped(base: str, name: str):
    """A file to read at any place: a memory map where its path is local."""
    fs, path = pafs.FileSystem.from_uri(base)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(f"{path}/{name}", "r")
    return fs.open_input_file(f"{path}/{name}")
