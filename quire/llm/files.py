"""Files of the shared folder, listed by name."""

from __future__ import annotations

from pyarrow import fs

from quire.sources.paths import make_dir, opened

__all__ = ["listed", "make_dir", "opened"]


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Files of a folder by name: (uri, bytes)."""
    system, path = opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    scheme = uri[: len(uri) - len(path)] if uri.endswith(path) and "://" in uri else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))
