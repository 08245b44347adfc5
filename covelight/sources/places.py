"""Small files in any place that pyarrow's file systems reach, local or remote. A file is written under another name and
renamed, so it is there whole or not at all."""

from __future__ import annotations

import os
import re
import uuid


def open_place(path: str):
    """(file system, path in it); a bare path or Hadoop's file:/x is local."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), os.path.abspath(local))


def _parent(place: str) -> str:
    return place.rpartition("/")[0]


def exists(path: str) -> bool:
    from pyarrow.fs import FileType

    system, place = open_place(path)
    return system.get_file_info(place).type != FileType.NotFound


def write_text(path: str, text: str) -> None:
    system, place = open_place(path)
    system.create_dir(_parent(place) or ".", recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(text.encode())
    system.move(part, place)


def rename(part: str, path: str) -> None:
    """Puts a finished file or folder in its place; one that stood there goes."""
    from pyarrow.fs import FileType

    system, new = open_place(part)
    _, place = open_place(path)
    system.create_dir(_parent(place) or ".", recursive=True)
    old = system.get_file_info(place).type
    if old == FileType.Directory:
        away = f"{place}.{uuid.uuid4().hex}.old"
        system.move(place, away)
        system.move(new, place)
        system.delete_dir(away)
    else:
        system.move(new, place)


def remove(path: str) -> None:
    from pyarrow.fs import FileType

    system, place = open_place(path)
    kind = system.get_file_info(place).type
    if kind == FileType.Directory:
        system.delete_dir(place)
    elif kind == FileType.File:
        system.delete_file(place)
