"""Byte ranges of files on any file system that Arrow knows, for the sources of this package."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyarrow import fs


class FormatError(ValueError):
    """A file that is not what its head says, or has none."""


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)


def parts_of(system: fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """Names and bytes of the file, or of the files of the folder in their order; hidden ones are left out."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FormatError(f"no such file: {path}")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = [x for x in system.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [(x.path, x.size) for x in sorted(inside, key=lambda x: x.base_name)]


def local_path(path: str) -> str:
    """The path of a file that can be written at any place in it."""
    system, name = place(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise FormatError("this form is written at many places of a file at once, which only a mounted file system allows")
    return posixpath.abspath(name)


def lines_from(system: fs.FileSystem, path: str, low: int, high: int, step: int = 4 << 20) -> Iterator[list[bytes]]:
    """Lines that begin in [low, high), in lists; a line belongs to the range in which its first byte is."""
    with system.open_input_file(path) as f:
        at, held = max(0, low - 1), b""
        begun = low == 0
        while True:
            chunk = f.read_at(step, at)
            if not chunk:
                if begun and held:
                    yield [held]
                return
            at, held = at + len(chunk), held + chunk
            if not begun:  # the line that is open at the byte before belongs to the range before
                cut = held.find(b"\n")
                if cut < 0:
                    held = b""
                    continue
                held, begun = held[cut + 1 :], True
            # ``held`` begins at byte at - len(held)
            first, lines = at - len(held), held.split(b"\n")
            held = lines.pop()
            out = []
            for line in lines:
                if first >= high:
                    break
                out.append(line)
                first += len(line) + 1
            if out:
                yield out
            if first >= high:
                return
