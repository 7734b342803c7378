"""Files in shared storage, written and read in place by tasks (any file system that Arrow can open)."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def create(path: str):
    """An output stream for a new file; folders above it are made."""
    store, name = locate(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name, compression=None)


def write(path: str, data: bytes) -> None:
    with create(path) as out:
        out.write(data)


def replace(path: str, data: bytes, draft: str) -> None:
    """Put a file in place in one step, by way of ``path`` + ``draft``."""
    store, name = locate(path)
    write(path + draft, data)
    store.move(name + draft, name)


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """A file, or a range of it."""
    store, name = locate(path)
    with store.open_input_file(name) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
