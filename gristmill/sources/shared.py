"""Small files in folders that all machines share, written and read by tasks."""

from __future__ import annotations

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ``file:/x`` and plain paths are mounts that all machines have."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def write_file(uri: str, data: bytes) -> None:
    """Under another name first, so that a reader never sees half a file."""
    where, path = located(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path + ".part", compression=None) as f:
        f.write(data)
    where.move(path + ".part", path)


def read_file(uri: str) -> bytes | None:
    """The bytes of a file, None where there is none."""
    where, path = located(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(path, compression=None) as f:  # as it is, whatever the name ends with
        return f.read()
