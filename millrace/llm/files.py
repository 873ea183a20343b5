"""Files in the shared folder, opened by executors through pyarrow."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(folder: str):
    """(file system, path) of a folder given as a URI or a path."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class NewFile:
    """A file of its own name for each task attempt, so that a lost attempt never harms another's."""

    def __init__(self, folder: str, suffix: str):
        self.system, path = at(folder)
        self.system.create_dir(path, recursive=True)
        self.name = uuid.uuid4().hex + suffix
        self.stream = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; the offset at which ``data`` begins."""
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.stream.close()
