"""Single files in a store, by pyarrow's file systems (local, HDFS, S3 and others, chosen by the address)."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def put(folder: str, name: str, data: bytes) -> None:
    """One whole file: written beside its place, then moved there. folder: a path or an address such as hdfs://host/path."""
    if "/" in name or name in ("", ".", ".."):
        raise ValueError(f"not a plain file name: {name!r}")
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    draft = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, posixpath.join(root, name))
