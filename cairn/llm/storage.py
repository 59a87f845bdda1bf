"""Files of our own formats in the shared folder, through Arrow's file systems (local, HDFS, S3, GCS).

A task writes under a name of its own and reports it in its result row; readers take only reported
names, so a lost executor or a retried task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_dir(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_file(uri: str, ending: str) -> tuple[fs.FileSystem, str]:
    """A file system and a fresh path in the folder `uri`, which is made if absent."""
    system, path = open_dir(uri)
    system.create_dir(path, recursive=True)
    return system, f"{path.rstrip('/')}/{uuid.uuid4().hex}.{ending}"


def remove_dir(uri: str) -> None:
    system, path = open_dir(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)
