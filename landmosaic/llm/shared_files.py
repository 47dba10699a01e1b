"""Files in a folder that all executors share, reached by its URI with Arrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


@contextmanager
def new_file(uri: str):
    """A file that appears under its name only when whole: a task that is tried again replaces it."""
    store, path = of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with store.open_output_stream(draft) as out:
        yield out
    store.move(draft, path)


@contextmanager
def opened(uri: str):
    store, path = of(uri)
    with store.open_input_file(path) as f:
        yield f


def sizes(uri: str, suffix: str) -> list[tuple[str, int]]:
    """URIs and bytes of the files below a folder."""
    store, path = of(uri)
    scheme = uri.split("://", 1)[0] + "://" if "://" in uri else ""
    prefix = scheme + uri[len(scheme) :].split("/", 1)[0] if scheme not in ("", "file://") else scheme
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    join = lambda p: f"{prefix}{p if p.startswith('/') or not prefix else '/' + p}" if scheme == "file://" or not scheme else f"{scheme}{p}"
    return sorted((join(f.path), f.size) for f in found if f.is_file and f.path.endswith(suffix))
