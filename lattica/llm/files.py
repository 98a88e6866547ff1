"""Binary files in the shared folder, written and range-read by tasks through Arrow's file systems.

A task writes under a name of its own (a retried or speculative task leaves a second file that
nothing refers to) and returns what it wrote as rows; the rows that Spark commits are the manifest.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(folder: str, suffix: str, pieces: list[bytes]) -> str:
    """Write a new file; its path."""
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, local = _open(path)
    system.create_dir(local.rpartition("/")[0], recursive=True)
    with system.open_output_stream(local, compression=None) as out:
        for piece in pieces:
            out.write(piece)
    return path


class Reader:
    """Range reads from one file at a time."""

    def __init__(self):
        self.path, self.file = "", None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            system, local = _open(path)
            self.path, self.file = path, system.open_input_file(local)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = "", None


def read(path: str) -> bytes:
    system, local = _open(path)
    with system.open_input_stream(local, compression=None) as file:
        return file.read()
