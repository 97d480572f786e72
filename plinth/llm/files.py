"""Files that executors write and read themselves, in the shared folder, through pyarrow's file systems.

A writer task names its file at random and reports it in its output row. The rows of the tasks that succeeded are the
manifest; what a failed or repeated attempt left behind isn't in it, so nobody reads that.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within of a URI (file:, hdfs:, s3:, gs:, viewfs:) or a plain local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@contextmanager
def new_file(folder: str, stem: str, suffix: str) -> Iterator[tuple[object, str]]:
    """A stream to a new file of its own below the folder, and the file's path."""
    system, place = opened(folder)
    system.create_dir(place, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    with system.open_output_stream(f"{place}/{name}", compression=None, buffer_size=1 << 20) as out:
        yield out, f"{folder}/{name}"


@contextmanager
def old_file(path: str) -> Iterator[object]:
    system, place = opened(path)
    with system.open_input_file(place) as source:
        yield source
