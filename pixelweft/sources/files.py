"""Files that executors write to a shared folder."""

from __future__ import annotations

import posixpath
import uuid


def open_output(uri: str):
    """A binary output stream on the shared folder. Returns the stream and a function that, after
    closing, moves the file to its final name, so that a retried task never leaves half a file."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    stream = where.open_output_stream(part)

    def commit() -> None:
        stream.close()
        where.move(part, path)

    return stream, commit
