"""Byte ranges of files and whole files, wherever Spark's own paths point to."""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a path as Spark writes it: local, ``hdfs``, ``s3``/``s3a`` or ``gs``."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class RangeReader:
    """Reads parts of one file."""

    def __init__(self, path: str):
        store, at = locate(path)
        self._file = store.open_input_file(at)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    @property
    def size(self) -> int:
        return self._file.size()

    def read(self, at: int, size: int) -> bytes:
        return self._file.read_at(max(0, min(size, self.size - at)), at)


class WholeFile:
    """Writes one file in pieces; it appears under its name when it is complete, so a lost attempt leaves none that looks whole."""

    def __init__(self, path: str):
        self._store, self._at = locate(path)
        folder, name = self._at.rsplit("/", 1)
        self._store.create_dir(folder, recursive=True)
        self._temporary = f"{folder}/_{uuid.uuid4().hex}-{name}"
        self._file = self._store.open_output_stream(self._temporary)

    def __enter__(self) -> WholeFile:
        return self

    def write(self, piece: bytes) -> None:
        self._file.write(piece)

    def __exit__(self, kind, *_) -> None:
        self._file.close()
        if kind is None:
            self._store.move(self._temporary, self._at)
        else:
            self._store.delete_file(self._temporary)
