"""Files by URI from inside tasks: local folders, and the stores that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def put(uri: str, data: bytes) -> None:
    """A whole small file: other readers see all of it or nothing."""
    where, path = at(uri)
    folder, _, name = path.rpartition("/")
    where.create_dir(folder, recursive=True)
    with where.open_output_stream(f"{folder}/_{name}.new") as out:
        out.write(data)
    where.move(f"{folder}/_{name}.new", path)


def get(uri: str) -> bytes | None:
    where, path = at(uri)
    if where.get_file_info(path).type != fs.FileType.File:
        return None
    with where.open_input_stream(path) as source:
        return source.read()


def drop(uri: str) -> None:
    where, path = at(uri)
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def names(uri: str) -> list[str]:
    """The names of the files of a folder, in order; none where there is no folder."""
    where, path = at(uri)
    if where.get_file_info(path).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(path)) if f.is_file)
