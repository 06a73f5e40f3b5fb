"""MATLAB files, built byte by byte by the formats' descriptions, read to sessions, placements and frequencies."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import montage
from epochlake.sources import readers
from epochlake.sources.matlab import cells_of, mat_cells

# -- level 5 -------------------------------------------------------------------

KINDS = {"i1": 1, "u1": 2, "i2": 3, "u2": 4, "i4": 5, "u4": 6, "f4": 7, "f8": 9, "i8": 12, "u8": 13}


def element(kind, body, order):
    if 0 < len(body) <= 4:
        return struct.pack(order + "I", len(body) << 16 | kind) + body.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name, value, order):
    """An array, a text or (as a list of lists) a cell array."""
    if isinstance(value, list):
        rows, cols = len(value), len(value[0])
        cls, shape, data = 1, (rows, cols), b"".join(matrix("", value[i][j], order) for j in range(cols) for i in range(rows))
    else:
        cls = 4 if isinstance(value, str) else 6
        x = np.array([[ord(c) for c in value]], dtype="u2") if cls == 4 else np.atleast_2d(value)
        shape = x.shape
        data = element(KINDS[x.dtype.str[1:]], x.astype(x.dtype.newbyteorder(order)).tobytes(order="F"), order)
    body = element(6, struct.pack(order + "II", cls, 0), order) + element(5, struct.pack(order + "ii", *shape), order) + element(1, name.encode(), order) + data
    return struct.pack(order + "II", 14, len(body)) + body


def level5(variables, order="<", compressed=True):
    head = b"MATLAB 5.0 MAT-file".ljust(116) + b"\0" * 8 + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    out = [matrix(k, v, order) for k, v in variables.items()]
    return head + b"".join(struct.pack(order + "II", 15, len(z)) + z for z in map(zlib.compress, out)) if compressed else head + b"".join(out)


# -- version 7.3 ---------------------------------------------------------------


class Hdf5Writer:
    """A file with a user block, a root group with a symbol table, and datasets in one of three layouts."""

    def __init__(self, layout="chunked", split=False):
        self.out, self.layout, self.split = bytearray(96), layout, split

    def put(self, raw):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    def header(self, messages):
        packed = [struct.pack("<HHB3x", kind, len(body) + -len(body) % 8, 0) + body + b"\0" * (-len(body) % 8) for kind, body in messages]
        if self.split and len(packed) > 1:  # the last message in a continuation
            more = self.put(packed[-1])
            packed = [*packed[:-1], struct.pack("<HHB3xQQ", 0x10, 16, 0, more, len(packed[-1]))]
            count = len(packed) + 1
        else:
            count = len(packed)
        raw = b"".join(packed)
        return self.put(struct.pack("<BxHII4x", 1, count, 1, len(raw)) + raw)

    def dataset(self, x, reference=False):
        x = np.ascontiguousarray(np.atleast_2d(x).T)  # as the format has it
        size = x.dtype.itemsize
        space = struct.pack("<BBBx4x", 1, x.ndim, 0) + struct.pack(f"<{x.ndim}Q", *x.shape)
        cls, bits = (7, 0) if reference else (1, 0x20) if x.dtype.kind == "f" else (0, 8 if x.dtype.kind == "i" else 0)
        messages = [(0x01, space), (0x03, struct.pack("<BBBBI", 0x10 | cls, bits, 0, 0, size) + b"\0" * 12)]
        if self.layout == "compact" and x.nbytes < 60_000:
            messages.append((0x08, struct.pack("<BBH", 3, 0, x.nbytes) + x.tobytes()))
        elif self.layout == "contiguous" or reference:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(x.tobytes()), x.nbytes)))
        else:
            chunk = tuple(min(n, c) or 1 for n, c in zip(x.shape, (50, 3), strict=True))
            keys = []
            for i in range(0, x.shape[0], chunk[0]):
                for j in range(0, x.shape[1], chunk[1]):
                    part = np.zeros(chunk, dtype=x.dtype)
                    cut = x[i : i + chunk[0], j : j + chunk[1]]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    shuffled = np.frombuffer(part.tobytes(), dtype=np.uint8).reshape(-1, size).T.tobytes()
                    mask = 1 if len(keys) == 1 else 0  # the second chunk is not shuffled
                    raw = zlib.compress(part.tobytes() if mask else shuffled) + b"sum!"
                    keys.append((struct.pack("<IIQQQ", len(raw), mask, i, j, 0), self.put(raw)))
            half = max(1, len(keys) // 2)
            leaves = [self.put(b"TREE" + struct.pack("<BBHQQ", 1, 0, len(k), 0, 0) + b"".join(a + struct.pack("<Q", c) for a, c in k) + b"\0" * 32) for k in (keys[:half], keys[half:]) if k]
            firsts = [k[0][0] for k in (keys[:half], keys[half:]) if k]
            root = self.put(b"TREE" + struct.pack("<BBHQQ", 1, 1, len(leaves), 0, 0) + b"".join(a + struct.pack("<Q", c) for a, c in zip(firsts, leaves, strict=True)) + b"\0" * 32) if leaves else (1 << 64) - 1
            filters = struct.pack("<BB6x", 1, 3) + struct.pack("<HHHHI4x", 2, 0, 1, 1, size) + struct.pack("<HHHH8sI4x", 1, 8, 1, 1, b"deflate", 6) + struct.pack("<HHHH", 3, 0, 0, 0)
            messages += [(0x0B, filters), (0x08, struct.pack("<BBBQIII", 3, 2, 3, root, *chunk, size))]
        return self.header(messages)

    def value(self, v):
        if isinstance(v, list):
            refs = np.array([[self.value(x) for x in row] for row in v], dtype="u8")
            return self.dataset(refs, reference=True)
        return self.dataset(np.array([[ord(c) for c in v]], dtype="u2") if isinstance(v, str) else np.atleast_2d(v))

    def file(self, variables):
        at = {k: self.value(v) for k, v in sorted(variables.items())}
        names, offsets = b"\0" * 8, {}
        for k in at:
            offsets[k] = len(names)
            names += k.encode() + b"\0" * (8 - len(k) % 8)
        segment = self.put(names)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), (1 << 64) - 1, segment))
        node = self.put(b"SNOD" + struct.pack("<BxH", 1, len(at)) + b"".join(struct.pack("<QQI4x16x", offsets[k], a, 0) for k, a in at.items()))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, 0, 0) + struct.pack("<QQQ", 0, node, 0))
        root = self.header([(0x11, struct.pack("<QQ", tree, heap))])
        self.out[:96] = (b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 512, (1 << 64) - 1, len(self.out) + 512, (1 << 64) - 1) + struct.pack("<QQI4x16x", 0, root, 0))[:96]
        return b"MATLAB 7.3 MAT-file".ljust(512, b"\0") + bytes(self.out)


FORMATS = {
    "level5": lambda v: level5(v),
    "level5-big": lambda v: level5(v, ">", False),
    "chunked": lambda v: Hdf5Writer("chunked").file(v),
    "chunked-split": lambda v: Hdf5Writer("chunked", True).file(v),
    "contiguous": lambda v: Hdf5Writer("contiguous").file(v),
    "compact": lambda v: Hdf5Writer("compact").file(v),
}


@pytest.mark.parametrize("form", FORMATS)
def test_arrays_and_cells(form):
    rng = np.random.default_rng(1)
    arrays = [rng.standard_normal((7, 120)), rng.integers(-5, 9, (3, 4)).astype("i4"), rng.integers(0, 9, (1, 5)).astype("u1"), rng.standard_normal((200, 1)).astype("f4"), np.zeros((0, 0))]
    raw = FORMATS[form]({"other": np.arange(3.0), "data": [[*arrays], ["text", "", "dät", np.array([[2.5]]), np.arange(4.0)]], "frq": np.arange(9.0)[::-1]})
    got = {(r, c): x for r, c, x in cells_of(raw, "data")}
    assert set(got) == {(r, c) for r in range(2) for c in range(5)}
    for c, x in enumerate(arrays):
        if x.size:
            assert got[0, c].shape == x.shape and (got[0, c] == x).all()
        else:
            assert got[0, c].size == 0
    assert ["".join(map(chr, got[1, c].ravel())) for c in (0, 2)] == ["text", "dät"] and got[1, 3].item() == 2.5
    (only,) = cells_of(raw, "frq")
    assert only[:2] == (0, 0) and only[2].ravel().tolist() == list(range(8, -1, -1))
    with pytest.raises(ValueError, match="no variable"):
        cells_of(raw, "absent")


def session(rat, date, seed, channels=3, n=250):
    rng = np.random.default_rng(seed)
    eeg, t = rng.standard_normal((channels, n)), 5 + np.arange(n)[None, :] / 200
    return [rat, date, eeg, t, rng.random((1, 40)), np.linspace(5, 6, 40)[None, :], np.array([[5.5, 6.0]]), np.array([[1.0, 3.0]]), np.array([[5.7]]), np.array([[2.0]])]


def test_session_files(spark, tmp_path):
    want = {}
    for k, (form, write) in enumerate(FORMATS.items()):
        cells = session(f"r{k % 2}", f"0{k}0419", k)
        want[form] = cells
        layout = [[c] for c in cells] if k % 2 else [cells]  # a column or a row of cells
        (tmp_path / f"{form}.mat").write_bytes(write({"Data_eeg": layout}))
    good = (tmp_path / "chunked.mat").read_bytes()
    (tmp_path / "cut.mat").write_bytes(good[: len(good) // 3])
    (tmp_path / "cut5.mat").write_bytes((tmp_path / "level5-big.mat").read_bytes()[:3000])
    (tmp_path / "none.mat").write_bytes(b"x")
    (tmp_path / "few.mat").write_bytes(level5({"Data_eeg": [["r1", "d"]]}))
    (tmp_path / "other.mat").write_bytes(level5({"x": np.arange(3.0)}))
    rows = {r["path"].rsplit("/", 1)[1][:-4]: r for r in readers.mat_sessions(spark, f"file://{tmp_path}/*.mat").collect()}
    assert set(rows) == {*FORMATS, "cut", "cut5", "none", "few", "other"}
    for name in ("cut", "cut5", "none", "few", "other"):
        assert "Error" in rows[name]["error"] and rows[name]["eeg"] is None
    for form, cells in want.items():
        r = rows[form]
        assert r["error"] is None and (r["subject"], r["session"]) == tuple(cells[:2])
        assert np.array_equal(np.array(r["eeg"]), cells[2]) and np.array_equal(r["eeg_time"], cells[3][0])
        assert np.array_equal(r["velocity"], cells[4][0]) and r["event_times"] == [5.5, 6.0] and r["control_sizes"] == [2.0]
    signals, events, velocity, failures = readers.mat_recordings(readers.mat_sessions(spark, f"file://{tmp_path}/*.mat"))
    assert signals.count() == 3 * len(FORMATS) and events.count() == 3 * len(FORMATS) and failures.count() == 5
    assert {(r["fs"], r["t0"]) for r in signals.select("fs", "t0").collect()} == {(200.0, 5.0)} and velocity.count() == 40 * len(FORMATS)


@pytest.mark.parametrize("form", ["level5", "chunked"])
def test_placement_files(spark, tmp_path, form):
    plan = [("9", "a", [3, 1, 2]), ("9", "b", [3, 1, 2]), ("7", "a", [1, 2, 3]), ("7", "b", [1, 3, 2]), ("5", "a", [1, 2])]
    cells = [[rat, day, np.array(x, dtype=float)[:, None], [["mPFC"], ["motor"]]] for rat, day, x in plan]
    (tmp_path / "p.mat").write_bytes(FORMATS[form]({"eeg_channels": cells}))
    (tmp_path / "bad.mat").write_bytes(b"bad")
    found = readers.mat_placements(spark, f"file://{tmp_path}/*.mat")
    ok = found.where("error IS NULL")
    assert sorted((r["subject"], r["session"], r["map"]) for r in ok.collect()) == sorted(plan) and found.count() == len(plan) + 1
    assert [tuple(r) for r in montage.consistent_montage(ok, 3).collect()] == [("9", [3, 1, 2])]


def test_frequency_files(spark, tmp_path):
    f = np.geomspace(45, 1, 12)
    for form, write in FORMATS.items():
        path = tmp_path / f"{form}.mat"
        path.write_bytes(write({"frq": f[None, :]}))
        got = readers.every_second(readers.mat_frequencies(spark, f"file://{path}"))
        assert sorted(map(tuple, got.collect())) == [(i, f[i]) for i in range(0, 12, 2)]
    with pytest.raises(ValueError, match="no variable"):
        readers.mat_frequencies(spark, f"file://{path}", "other")


def test_cells_of_many_files_are_read_by_many_tasks(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.mat").write_bytes(level5({"frq": np.arange(4.0) + k}))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(200 << 20))
    try:
        cells = mat_cells(spark, f"file://{tmp_path}/*.mat", "frq").withColumn("task", F.spark_partition_id())
        assert cells.select("task").distinct().count() > 1 and sorted(r["v"][0] for r in cells.collect()) == [0, 1, 2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
