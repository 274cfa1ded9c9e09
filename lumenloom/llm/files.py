"""Raw files in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; paths come from common.qualified() and have a scheme.

    Hadoop's names for stores that Arrow calls otherwise are turned into those.
    """
    scheme, _, rest = path.partition(":")
    if not rest:
        raise ValueError(f"a path without a scheme lies elsewhere for Spark than for a task: {path}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def create(folder: str, stem: str, suffix: str) -> tuple[str, object]:
    """Path and stream of a new file; each attempt of a task gets a name of its own.

    Only files named in a manifest that a successful task returned are read, so
    what a lost or repeated attempt leaves behind does no harm.
    """
    path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, local = _at(path)
    system.create_dir(local.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(local, compression=None)


def open_random(path: str):
    system, local = _at(path)
    return system.open_input_file(local)


def read_all(path: str) -> bytes:
    with open_random(path) as f:
        return f.read()
