"""Files in any store, by the names that Spark uses."""

from __future__ import annotations


def open_store(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def save_bytes(content: bytes, uri: str) -> str:
    """An upload, written from the driver."""
    store, local = open_store(uri)
    store.create_dir(local.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(local) as out:
        out.write(content)
    return uri


def remove(uri: str) -> None:
    """Removes a folder and all in it, if it's there."""
    store, local = open_store(uri)
    from pyarrow import fs

    if store.get_file_info(local).type == fs.FileType.Directory:
        store.delete_dir(local)
