"""Opening files of the shared folder from tasks, whatever store it is in."""

from __future__ import annotations

import pyarrow.fs as pafs

#: What Hadoop calls a store, and what the library that opens it here does.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def named(uri: str) -> str:
    """The address as the library here has it: Hadoop's names of stores replaced, a bare path taken as local."""
    scheme, sep, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if sep else f"file://{uri}"


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(named(uri))


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Puts a finished file in its place; a repeated task attempt replaces it with the same bytes."""
    fs.move(temporary, final)
