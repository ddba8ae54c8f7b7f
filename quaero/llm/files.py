"""Binary files in the shared folder, written and read by executors.

Paths are URIs; pyarrow's file systems open them, so the same code reaches a
shared mount or an object store. A file gets its name only when it is whole,
so a repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def open_fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str):
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part, compression=None) as out:
            yield out
        fs.move(part, path)
    except BaseException:
        try:
            fs.delete_file(part)
        except OSError:
            pass
        raise


class RangeReader:
    """Byte ranges of a file in rising order, read in blocks."""

    def __init__(self, uri: str, block: int = 4 << 20):
        fs, path = open_fs(uri)
        self.file, self.block = fs.open_input_file(path), block
        self.start, self.held = 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not (self.start <= offset and offset + n <= self.start + len(self.held)):
            self.start, self.held = offset, self.file.read_at(max(n, self.block), offset)
        got = self.held[offset - self.start : offset - self.start + n]
        if len(got) != n:
            raise OSError(f"{n} bytes wanted at {offset}, {len(got)} found")
        return got

    def close(self) -> None:
        self.file.close()
