"""Byte access to local and remote files through pyarrow's file systems."""

from __future__ import annotations

import fnmatch
import os

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem


def resolve(path: str) -> tuple[FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return FileSystem.from_uri(path)
    return LocalFileSystem(), os.path.abspath(path)


def open_input(path: str):
    fs, p = resolve(path)
    return fs.open_input_file(p)


def open_output(path: str):
    fs, p = resolve(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    return fs.open_output_stream(p, compression=None)


def size(path: str) -> int:
    fs, p = resolve(path)
    return fs.get_file_info(p).size


def modified(path: str) -> float | None:
    """Seconds, or None where the file system doesn't say."""
    fs, p = resolve(path)
    t = fs.get_file_info(p).mtime_ns
    return None if t is None else t / 1e9


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type != FileType.NotFound


def is_folder(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type == FileType.Directory


def remove(path: str) -> None:
    fs, p = resolve(path)
    if fs.get_file_info(p).type != FileType.NotFound:
        fs.delete_file(p)


def move(path: str, to: str) -> None:
    """Within one file system; folders are made."""
    fs, p = resolve(path)
    q = resolve(to)[1]
    fs.create_dir(os.path.dirname(q), recursive=True)
    fs.move(p, q)


def remove_folder(path: str) -> None:
    fs, p = resolve(path)
    if fs.get_file_info(p).type == FileType.Directory:
        fs.delete_dir(p)


def names(path: str, folders: bool = False) -> list[str]:
    """Names of files in a folder (none if there is no such folder), but for hidden ones; or of folders."""
    fs, p = resolve(path)
    found = fs.get_file_info(FileSelector(p, allow_not_found=True))
    kind = FileType.Directory if folders else FileType.File
    return sorted(n for x in found if x.type == kind and not (n := os.path.basename(x.path)).startswith(("_", ".")))


def listing(path: str, suffix: str) -> list[str]:
    """Files with the suffix: the file itself, those of a folder, or those that a pattern names."""
    fs, p = resolve(path)
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    info = fs.get_file_info(p)
    if info.type == FileType.File:
        return [scheme + p]
    folder, pattern = (p, "*" + suffix) if info.type == FileType.Directory else (os.path.dirname(p), os.path.basename(p))
    found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    out = sorted(scheme + x.path for x in found if x.type == FileType.File and fnmatch.fnmatch(os.path.basename(x.path), pattern) and not os.path.basename(x.path).startswith(("_", ".")))
    if not out:
        raise FileNotFoundError(f"no file at {path}")
    return out
