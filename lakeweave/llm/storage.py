"""Files in the shared folder, from the driver and from executors, by any URI that Arrow's file systems know."""

from __future__ import annotations

import os

import numpy as np


def files_of(path: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def mapped(files, path: str):
    """The file's bytes: mapped where the file is local, read otherwise."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


