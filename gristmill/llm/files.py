"""File access from executors, through pyarrow's file systems, for folders that all machines share."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; ``file:/x`` and plain paths are taken as local-style shared mounts."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_file(uri: str, data: bytes) -> None:
    """Write under another name first, so that a reader never sees half a file."""
    where, path = open_fs(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path + ".tmp") as f:
        f.write(data)
    where.move(path + ".tmp", path)


def read_range(uri: str, start: int, length: int) -> bytes:
    where, path = open_fs(uri)
    with where.open_input_file(path) as f:
        return f.read_at(length, start)
