"""Sorted hash arrays and sketches in the shared folder, written and memory-mapped by Spark's tasks.

The folder is the one of spark.checkpoint.dir, named by a full URI, as Hadoop's file system resolves it: a path without
scheme lies where the cluster's default file system says, not on the machine that reads it. Folders of file: are mapped
in place; from another store a worker reads an array when it needs it and keeps a bounded number of bytes.

Every array is written by one task under a fixed name and put in place by a rename, so a repeated or speculative task
writes the same file again. A file starts with a mark and its length: one that is missing or cut short is an error,
never an empty array. Empty arrays are written too.
"""

from __future__ import annotations

import collections
import os
import uuid

import numpy as np
import pyarrow.fs

from tidewatch.sources.storage import fresh_folder

#: What a worker keeps at most: mapped files, and bytes read from stores that are not mounted.
KEPT_MAPS, KEPT_BYTES = 4096, 256 << 20

_MARK = b"ARRAY-01"
_HEAD = len(_MARK) + 8
_held: collections.OrderedDict[tuple[str, str], np.ndarray] = collections.OrderedDict()


def array_folder(spark, name: str) -> str:
    """The URI of a new folder for arrays; an error if Python tasks can't open that store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, name))
    uri = str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    if local(uri) is None:
        try:
            pyarrow.fs.FileSystem.from_uri(uri)
        except Exception as e:
            raise ValueError(f"arrays can't be kept in {uri}: set spark.checkpoint.dir to a mounted folder (file:) or a store that pyarrow opens") from e
    return uri


def local(path: str) -> str | None:
    """The mounted path of a file: URI, None for another store. A path without scheme names no store and is refused."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        raise ValueError(f"{path} has no scheme; use array_folder")
    return None


def write_array(path: str, values: np.ndarray) -> None:
    head, body = _MARK + int(values.nbytes).to_bytes(8, "little"), np.ascontiguousarray(values)
    here = local(path)
    if here is None:
        store, name = pyarrow.fs.FileSystem.from_uri(path)
        part = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(head)
            out.write(body.tobytes())
        store.move(part, name)
        return
    os.makedirs(os.path.dirname(here), exist_ok=True)
    part = f"{here}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(head)
        body.tofile(out)
    os.replace(part, here)


def _length(path: str, head: bytes, size: int) -> int:
    n = int.from_bytes(head[len(_MARK):], "little")
    if head[:len(_MARK)] != _MARK or size != n + _HEAD:
        raise OSError(f"{path} is cut short or no array")
    return n


def read_array(path: str, dtype) -> np.ndarray:
    """The array, memory-mapped where the folder is mounted. A missing or short file is an error."""
    here = local(path)
    if here is None:
        store, name = pyarrow.fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as source:
            n = _length(path, source.read(_HEAD), source.size())
            return np.frombuffer(source.read(n), dtype)
    with open(here, "rb") as source:
        n = _length(path, source.read(_HEAD), os.fstat(source.fileno()).st_size)
        return np.memmap(source, dtype=dtype, mode="r", offset=_HEAD, shape=n // np.dtype(dtype).itemsize) if n else np.zeros(0, dtype)


def array(path: str, dtype) -> np.ndarray:
    """read_array, kept in this process until others push it out."""
    key = path, np.dtype(dtype).str
    if key in _held:
        _held.move_to_end(key)
        return _held[key]
    _held[key] = found = read_array(path, dtype)
    mounted = local(path) is not None
    total = 0 if mounted else sum(a.nbytes for a in _held.values() if not isinstance(a, np.memmap))
    while len(_held) > 1 and (len(_held) > KEPT_MAPS or total > KEPT_BYTES):
        gone = _held.popitem(last=False)[1]
        total -= 0 if isinstance(gone, np.memmap) else gone.nbytes
    return found


def encode(values: np.ndarray, dtype=np.uint8) -> bytes:
    """A sorted array, duplicates included, as gaps; a gap of more than the type's maximum takes several."""
    most = np.uint64(np.iinfo(dtype).max)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    more, rest = gaps // most, gaps % most
    ends = np.cumsum(more.astype(np.int64) + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, most, dtype=dtype)
    out[ends] = rest.astype(dtype)
    return out.tobytes()


def decode(data: bytes, dtype=np.uint8) -> np.ndarray:
    gaps = np.frombuffer(data, dtype)
    return np.cumsum(gaps, dtype=np.uint64)[gaps != np.iinfo(dtype).max]


def find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in a sorted array, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)
