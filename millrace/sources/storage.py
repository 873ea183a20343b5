"""Files of any file system that pyarrow opens, by glob and by ranges of whole lines."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

BLOCK = 1 << 20


def system_of(uri: str):
    """(file system, path in it) of a URI or a local path."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass(frozen=True)
class Found:
    """A file: its name as the pattern would write it, bytes, and time of its last change in seconds."""

    name: str
    size: int
    changed: float


def found_files(pattern: str) -> list[Found]:
    """Files that a glob finds, by name; ``*`` stays within a folder's name. A folder that is not there holds none."""
    parts = pattern.rstrip("/").split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts) - 1)
    base, wanted = "/".join(parts[:fixed]) or "/", parts[fixed:]
    system, path = system_of(base)
    path = path.rstrip("/")
    at, listed = [path], []
    for part in wanted:  # only folders that match are listed, and none for a name that is given
        if any(c in part for c in "*?["):
            listed = [i for p in at for i in system.get_file_info(fs.FileSelector(p or "/", allow_not_found=True)) if fnmatch.fnmatchcase(i.base_name, part)]
        else:
            listed = system.get_file_info([f"{p}/{part}" for p in at])
        at = [i.path for i in listed if i.type == fs.FileType.Directory]
    out = []
    for info in listed:
        if info.type == fs.FileType.File:
            inner = info.path[len(path) :].strip("/")
            out.append(Found(f"{base.rstrip('/')}/{inner}", info.size, info.mtime.timestamp() if info.mtime else 0.0))
    return sorted(out, key=lambda f: f.name)


def exists(uri: str) -> bool:
    system, path = system_of(uri)
    return system.get_file_info(path).type == fs.FileType.File


def whole_text(uri: str) -> bytes | None:
    """All bytes of a small file, or None if there is none."""
    if not exists(uri):
        return None
    system, path = system_of(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def end_of_lines(uri: str, size: int) -> int:
    """The byte behind the last line end of a file's first ``size`` bytes."""
    system, path = system_of(uri)
    with system.open_input_file(path) as f:
        at = size
        while at > 0:
            begin = max(0, at - BLOCK)
            newline = f.read_at(at - begin, begin).rfind(b"\n")
            if newline >= 0:
                return begin + newline + 1
            at = begin
    return 0


def ranges(start: int, stop: int, most: int) -> list[tuple[int, int]]:
    return [(at, min(stop, at + most)) for at in range(start, stop, most)]


def lines_between(uri: str, start: int, stop: int, base: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) of the lines that begin in [start, stop); ``base`` is where a line is known to begin."""
    system, path = system_of(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        at = start
        if start > base:  # the line that goes over the start belongs to the range before
            at = start - 1
            while at < size:
                data = f.read_at(min(BLOCK, size - at), at)
                newline = data.find(b"\n")
                if newline >= 0:
                    at += newline + 1
                    break
                at += len(data)
        held, read = b"", at
        while at < stop and (read < size or held):
            data = f.read_at(min(BLOCK, size - read), read) if read < size else b""
            read += len(data)
            *whole, held = (held + data).split(b"\n")
            for line in whole:
                if at >= stop:
                    return
                yield at, line + b"\n"
                at += len(line) + 1
            if not data:
                if held and at < stop:
                    yield at, held
                return


def line_number(uri: str, offset: int) -> int:
    """The number of the line that begins at ``offset``; the file is read up to there, so this is for errors."""
    system, path = system_of(uri)
    with system.open_input_file(path) as f:
        return 1 + sum(f.read_at(min(BLOCK, offset - at), at).count(b"\n") for at in range(0, offset, BLOCK))
