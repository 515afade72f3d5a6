"""Files in the shared folder by URI."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; `file:/x`, `file:///x` and plain paths are local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
