"""Files in the shared folder, written and read inside tasks through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as file:///shared/x or hdfs://host/x."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Replacing:
    """Writes under a name of this attempt's own and moves the whole file to its name at the end, so that a retried or
    speculative task leaves one complete file."""

    def __init__(self, uri: str, attempt: int) -> None:
        self._fs, self._path = at(uri)
        self._temporary = f"{self._path}.{attempt}.part"
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._out = self._fs.open_output_stream(self._temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self._out.close()
        self._fs.move(self._temporary, self._path)
