"""MATLAB files as rows of cells, by the public descriptions of the two formats: level 5 and HDF5 (version 7.3).

Of HDF5 the part that such files use: superblock 0, version 1 object headers, symbol table groups, compact, contiguous and
chunked data with deflate, shuffle and checksum filters, object references.  Files come from Spark's own reader, so they may
lie in any store that Spark reads; one task holds one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

HDF5_SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Element types of level 5 files, by number, and those that hold other elements (fixed values).
LEVEL5_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL_CLASS, OBJECT_CLASSES = 1, (2, 3, 5)
#: Message types of object headers, and filters (fixed values).
DATASPACE, DATATYPE, LAYOUT, FILTERS, CONTINUATION, SYMBOL_TABLE = 0x01, 0x03, 0x08, 0x0B, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3
NOWHERE = (1 << 64) - 1

Cell = tuple[int, int, np.ndarray]


def cells_of(content: bytes, variable: str) -> list[Cell]:
    """(row, column, array) of every cell of a cell array, or of a plain array as its only cell; rows and columns as MATLAB
    counts them, from 0.  ValueError where the file is neither format, or lacks the variable."""
    for at in (0, 512, 1024, 2048):
        if content[at : at + 8] == HDF5_SIGNATURE:
            return Hdf5(content, at).cells(variable)
    if len(content) >= 128 and content[126:128] in (b"IM", b"MI"):
        return level5_cells(content, variable)
    raise ValueError("neither a level 5 nor a version 7.3 file")


# -- level 5 -------------------------------------------------------------------


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, bytes) of each element; compressed ones opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: size and type share a word
            kind, size, begin, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            begin, step = at + 8, 8 + size + (0 if kind == COMPRESSED else -size % 8)
        body = data[begin : begin + size]
        if len(body) < size:
            raise ValueError("file ends within an element")
        if kind == COMPRESSED:
            yield from _elements(memoryview(zlib.decompress(body)), order)
        else:
            yield kind, body
        at += step


def _numbers(kind: int, body: memoryview, order: str) -> np.ndarray:
    if kind not in LEVEL5_TYPES:
        raise ValueError(f"element type {kind}")
    return np.frombuffer(body, dtype=order + LEVEL5_TYPES[kind])


def _matrix(body: memoryview, order: str) -> tuple[str, int, list[int], list[tuple[int, memoryview]]]:
    """(name, class, dimensions, elements of the data) of a matrix."""
    flags, size, name, *rest = _elements(body, order)
    return bytes(name[1]).decode("ascii", "replace"), int(_numbers(*flags, order)[0]) & 0xFF, _numbers(*size, order).tolist(), rest


def _values(cls: int, shape: list[int], rest: list[tuple[int, memoryview]], order: str) -> np.ndarray:
    if cls in (CELL_CLASS, *OBJECT_CLASSES):  # what is nested further has no values here
        return np.zeros((0, 0))
    return (_numbers(*rest[0], order) if rest else np.zeros(0)).reshape(shape, order="F")


def level5_cells(content: bytes, variable: str) -> list[Cell]:
    order = "<" if content[126:128] == b"IM" else ">"
    for kind, body in _elements(memoryview(content)[128:], order):
        if kind != MATRIX:
            continue
        name, cls, shape, rest = _matrix(body, order)
        if name != variable:
            continue
        if cls != CELL_CLASS:
            return [(0, 0, _values(cls, shape, rest, order))]
        out = []
        for i, (_, inner) in enumerate(rest):
            _, c, s, r = _matrix(inner, order)
            out.append((i % max(shape[0], 1), i // max(shape[0], 1), _values(c, s, r, order)))
        return out
    raise ValueError(f"no variable {variable}")


# -- HDF5 ----------------------------------------------------------------------


class Hdf5:
    """Datasets of a file by name or by address; MATLAB's first dimension is the last one here, so shapes are turned."""

    def __init__(self, content: bytes, base: int):
        self.data = memoryview(content)[base:]
        version, offsets, lengths = self.data[8], self.data[13], self.data[14]
        if version != 0 or offsets != 8 or lengths != 8:
            raise ValueError(f"superblock {version} with addresses of {offsets} bytes")
        self.root = self._read("<Q", 24 + 4 * 8 + 8)[0]

    def _read(self, form: str, at: int) -> tuple:
        if at + struct.calcsize(form) > len(self.data):
            raise ValueError("file ends early")
        return struct.unpack_from(form, self.data, at)

    def messages(self, address: int) -> list[tuple[int, memoryview]]:
        """(type, body) of an object's header."""
        version, _, count, _, size = self._read("<BBHII", address)
        if version != 1:
            raise ValueError(f"object header of version {version}")
        out, blocks = [], [(address + 16, size)]
        while blocks and len(out) < count:
            at, left = blocks.pop(0)
            end = at + left
            while at + 8 <= end and len(out) < count:
                kind, size = self._read("<HH", at)
                body = self.data[at + 8 : at + 8 + size]
                out.append((kind, body))
                if kind == CONTINUATION:
                    blocks.append(struct.unpack_from("<QQ", body))
                at += 8 + size
        return out

    def members(self) -> dict[str, int]:
        """Addresses of the root group's objects by name."""
        table = dict(self.messages(self.root)).get(SYMBOL_TABLE)
        if table is None:
            raise ValueError("root group without a symbol table")
        tree, heap = struct.unpack_from("<QQ", table)
        names = self._read("<Q", heap + 24)[0]
        out = {}
        for node in self._leaves(tree, 8):
            for k in range(self._read("<H", node + 6)[0]):
                name, address = self._read("<QQ", node + 8 + 40 * k)
                text = bytes(self.data[names + name : names + name + 512])
                out[text.split(b"\0", 1)[0].decode()] = address
        return out

    def _leaves(self, tree: int, key: int, keys: bool = False) -> Iterator:
        """Children of a version 1 B-tree's lowest level, with the bytes of their keys if asked for."""
        if bytes(self.data[tree : tree + 4]) != b"TREE":
            raise ValueError("no B-tree where one should be")
        _, level, used = self._read("<BBH", tree + 4)
        for k in range(used):
            at = tree + 24 + k * (key + 8)
            child = self._read("<Q", at + key)[0]
            if level:
                yield from self._leaves(child, key, keys)
            else:
                yield (self.data[at : at + key], child) if keys else child

    def dataset(self, address: int) -> np.ndarray:
        """Values of a dataset as MATLAB has them; references as addresses."""
        found = dict(self.messages(address))
        if not {DATASPACE, DATATYPE, LAYOUT} <= found.keys():
            raise ValueError("not a dataset")
        space, kind = found[DATASPACE], found[DATATYPE]
        at = 8 if space[0] == 1 else 4
        shape = struct.unpack_from(f"<{space[1]}Q", space, at)
        cls, bits, size = kind[0] & 15, kind[1], struct.unpack_from("<I", kind, 4)[0]
        letter = {0: "i" if bits & 8 else "u", 1: "f", 4: "u", 7: "u"}.get(cls)
        if letter is None:
            raise ValueError(f"datatype of class {cls}")
        dtype = np.dtype(("<" if cls == 7 or not bits & 1 else ">") + letter + str(size))
        raw = self._stored(found[LAYOUT], found.get(FILTERS), shape, dtype)
        return raw.T

    def _stored(self, layout: memoryview, filters: memoryview | None, shape: tuple, dtype: np.dtype) -> np.ndarray:
        if layout[0] != 3:
            raise ValueError(f"layout of version {layout[0]}")
        if layout[1] == 0:
            return np.frombuffer(layout[4 : 4 + struct.unpack_from("<H", layout, 2)[0]], dtype=dtype).reshape(shape)
        if layout[1] == 1:
            at, size = struct.unpack_from("<QQ", layout, 2)
            if at == NOWHERE:
                return np.zeros(shape, dtype=dtype)
            if at + size > len(self.data):
                raise ValueError("file ends within a dataset")
            return np.frombuffer(self.data[at : at + size], dtype=dtype).reshape(shape)
        rank = layout[2] - 1
        tree = struct.unpack_from("<Q", layout, 3)[0]
        chunk = struct.unpack_from(f"<{rank}I", layout, 11)
        out = np.zeros(shape, dtype=dtype)
        if tree == NOWHERE:
            return out
        order = _filters(filters)
        for key, child in self._leaves(tree, 8 + 8 * (rank + 1), keys=True):
            size, mask = struct.unpack_from("<II", key)
            first = struct.unpack_from(f"<{rank}Q", key, 8)
            raw = bytes(self.data[child : child + size])
            for k, f in reversed(list(enumerate(order))):
                raw = raw if mask >> k & 1 else _unfiltered(f, raw, dtype.itemsize)
            part = tuple(slice(a, min(a + c, n)) for a, c, n in zip(first, chunk, shape, strict=True))
            out[part] = np.frombuffer(raw, dtype=dtype).reshape(chunk)[tuple(slice(0, s.stop - s.start) for s in part)]
        return out

    def cells(self, variable: str) -> list[Cell]:
        members = self.members()
        if variable not in members:
            raise ValueError(f"no variable {variable}")
        kind = dict(self.messages(members[variable])).get(DATATYPE)
        found = self.dataset(members[variable])
        if kind[0] & 15 != 7:
            return [(0, 0, found)]
        two = found.reshape(found.shape[0], -1) if found.ndim else found.reshape(1, 1)
        return [(i, j, self.dataset(int(two[i, j]))) for j in range(two.shape[1]) for i in range(two.shape[0])]


def _filters(message: memoryview | None) -> list[int]:
    if message is None:
        return []
    version, count = message[0], message[1]
    out, at = [], 8 if version == 1 else 2
    for _ in range(count):
        number = struct.unpack_from("<H", message, at)[0]
        named = version == 1 or number >= 256
        name = struct.unpack_from("<H", message, at + 2)[0] if named else 0
        at += 4 if named else 2
        values = struct.unpack_from("<H", message, at + 2)[0]
        at += 4 + (name + -name % 8 if version == 1 else name) + 4 * values + (4 if version == 1 and values % 2 else 0)
        out.append(number)
    return out


def _unfiltered(number: int, raw: bytes, item: int) -> bytes:
    if number == DEFLATE:
        return zlib.decompress(raw)
    if number == SHUFFLE:
        n = len(raw) // item
        return np.frombuffer(raw, dtype=np.uint8)[: n * item].reshape(item, n).T.tobytes() + raw[n * item :]
    if number == FLETCHER:
        return raw[:-4]
    raise ValueError(f"filter {number}")


# -- as tables -----------------------------------------------------------------


def mat_cells(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(path, row, col, shape array<int>, v array<double>, error): a row for each cell of the variable in each file (a plain
    array is one cell), values in MATLAB's order, column by column, characters as codes; a file that can't be read is one
    row with error (Spark's reader leaves out files of no bytes)."""
    schema = "path string, row int, col int, shape array<int>, v array<double>, error string"
    arrow = pa.schema([("path", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("shape", pa.list_(pa.int32())), ("v", pa.list_(pa.float64())), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    found = [(r, c, x.shape, np.asarray(x, dtype=np.float64).ravel(order="F")) for r, c, x in cells_of(content.as_py(), variable)]
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    yield pa.RecordBatch.from_pylist([{"path": name, "error": f"{type(e).__name__}: {e}"}], schema=arrow)
                    continue
                for r, c, shape, x in found:
                    cols = [pa.array([name]), pa.array([r], pa.int32()), pa.array([c], pa.int32()), pa.array([shape], pa.list_(pa.int32())), pa.ListArray.from_arrays(np.array([0, len(x)], dtype="i4"), x), pa.nulls(1, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
