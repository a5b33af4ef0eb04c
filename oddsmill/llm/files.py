"""Binary files that tasks write to and read from the shared folder, by URI (file, s3, gs, hdfs and what else Arrow opens)."""
from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def new_name(uri: str, stem: str, suffix: str) -> str:
    """A name that no other attempt of a task uses: only names in a finished attempt's rows are ever read."""
    return f"{uri.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"


def write_stream(uri: str):
    system, path = opened(uri)
    return system.open_output_stream(path, compression=None)


def read_stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)


def read_file(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)
