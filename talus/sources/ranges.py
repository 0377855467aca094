"""Range reads and whole writes of binary files by Spark's Python tasks, on local, shared or remote file systems."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), os.path.abspath(path)


class Reader:
    """An open file that is read by ranges."""

    def __init__(self, path: str):
        system, inner = locate(path)
        self._file = system.open_input_file(inner)
        self.size = self._file.size()

    def read(self, start: int, length: int) -> bytes:
        """The bytes of a range; a file that ends before raises."""
        data = self._file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"the file ends within bytes {start} to {start + length}")
        return data

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@contextmanager
def writing(path: str) -> Iterator:
    """A stream into a file of another name, which takes its own name when all is written: a task that is lost leaves no half
    of a file under that name."""
    system, inner = locate(path)
    other = f"{inner}.{uuid4().hex}"
    with system.open_output_stream(other) as out:
        yield out
    system.move(other, inner)
