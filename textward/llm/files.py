"""Files in the shared folder, opened from Python tasks by their URI."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file:, hdfs:, s3:, gs: ...) or an absolute path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, chunks) -> int:
    """Write chunks of bytes under another name, then move: a repeated task replaces a whole file by an equal one."""
    system, path = resolve(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}", 0
    with system.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(part, path)
    return size


def mapped(uri: str, dtype) -> np.ndarray:
    """A file's array: memory-mapped where the folder is mounted, else read."""
    system, path = resolve(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with system.open_input_stream(path, compression=None) as f:
        return np.frombuffer(f.read(), dtype)
