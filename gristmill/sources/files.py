"""Files that tasks read and write by themselves, on a store that all executors reach."""

from __future__ import annotations

import uuid

# Schemes of Hadoop listings that Arrow knows by another name.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def arrow_uri(uri: str) -> str:
    scheme, mark, rest = uri.partition("://")
    return f"{ARROW_SCHEMES.get(scheme, scheme)}{mark}{rest}"


def open_uri(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(arrow_uri(uri))


def write_whole(files, target: str, *parts: bytes) -> None:
    """Write under a name of its own, then move into place: a retried or speculative task
    leaves the same file."""
    scratch = f"{target}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(scratch) as out:
        for part in parts:
            out.write(part)
    files.move(scratch, target)
