"""Files that tasks and writers open themselves, on any filesystem that Arrow knows; whole files appear by a rename."""

from __future__ import annotations

import json

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write(uri: str, data: bytes) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)


def read(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def exists(uri: str) -> bool:
    fs, path = open_fs(uri)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def delete(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        fs.delete_file(path)


def names(uri: str) -> list[str]:
    """Names of the files of a folder, sorted; none if there is no such folder."""
    fs, path = open_fs(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def publish(uri: str, document: dict) -> None:
    """Writes a document beside its place and renames it there, so it is met whole or not at all."""
    fs, path = open_fs(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{name}.tmp", compression=None) as out:
        out.write(json.dumps(document).encode())
    fs.move(f"{folder}/.{name}.tmp", path)
