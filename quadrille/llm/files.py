"""Files in the shared folder, by URI, from the driver and from executors."""

from __future__ import annotations

from pyarrow import fs


#: Schemes of Hadoop's connectors, and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    scheme, rest = uri.split("://", 1)
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it. A path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(arrow_uri(uri))


def listed(uri: str, ending: str) -> list[tuple[str, int]]:
    """(name, size) of the files of a folder, by name."""
    system, path = place(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(ending))


def made(uri: str) -> None:
    system, path = place(uri)
    system.create_dir(path, recursive=True)


def put(uri: str, name: str, data: bytes) -> None:
    system, path = place(uri)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def ranged(uri: str, name: str, at: int, size: int) -> bytes:
    """size bytes of a file from at on."""
    system, path = place(uri)
    with system.open_input_file(f"{path}/{name}") as f:
        f.seek(at)
        return f.read(size)


def own_name(part: int, attempt: int, ending: str, number: int = 0) -> str:
    """A file's name by its task and attempt. Nothing is renamed: a list of files, written last, says which count."""
    return f"part-{part:06d}-{number:04d}-{attempt}{ending}"


def swept(uri: str, ending: str, kept: set[str]) -> None:
    """Delete what attempts that do not count have left."""
    for name, _ in listed(uri, ending):
        if name not in kept:
            dropped(uri, name)


def dropped(uri: str, name: str) -> None:
    system, path = place(uri)
    try:
        system.delete_file(f"{path}/{name}")
    except FileNotFoundError:
        pass
