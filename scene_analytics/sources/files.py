"""Files of any store from within a task."""

from __future__ import annotations

import re


def store_of(path: str):
    """(file system, path in it) of a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def opened(path: str):
    """The file, open for reading at any place."""
    store, where = store_of(path)
    return store.open_input_file(where)
