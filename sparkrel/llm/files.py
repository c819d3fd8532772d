"""Files in a store that every executor reaches: written under a temporary name, then renamed.

A task that runs again after a lost executor writes the same bytes to the same name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator[pa.NativeFile]:
    """A stream to *uri*, which appears there whole or not at all."""
    store, path = place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with store.open_output_stream(draft, compression=None, buffer_size=1 << 20) as out:
            yield out
        store.move(draft, path)
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise


@contextmanager
def reading(uri: str) -> Iterator[pa.NativeFile]:
    store, path = place(uri)
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as src:
        yield src
