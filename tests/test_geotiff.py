"""Strips and tiles, Deflate and LZW, predictors, byte orders, several samples; headers without the rest; damaged files."""

import struct
import zlib

import numpy as np
import pytest

from fringeflow.errors import RasterError, StackIOError, UnsupportedFormat
from fringeflow.operators.cube import Meta
from fringeflow.sources import files, geotiff


def lzw(data):
    """A plain TIFF LZW encoder."""
    out, bits, held = bytearray(), 0, 0
    table, width = {bytes([k]): k for k in range(256)}, 9

    def put(code):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    now = b""
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in table:
            now = more
            continue
        put(table[now])
        table[more] = len(table) + 2
        now = data[k : k + 1]
        size = len(table) + 2
        if size >= 4094:
            put(256)
            table, width = {bytes([c]): c for c in range(256)}, 9
        else:
            width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    if now:
        put(table[now])
    put(257)
    return bytes(out) + bytes([held << (8 - bits) & 255] if bits else [])


def packed(block, predictor, order):
    rows, cols, samples = block.shape
    kind = block.dtype.newbyteorder(order)
    if predictor == 1:
        return block.astype(kind).tobytes()
    if predictor == 2:
        x = np.ascontiguousarray(block).view(f"u{kind.itemsize}").copy()
        x[:, 1:] -= x[:, :-1].copy()
        return x.astype(f"{order}u{kind.itemsize}").tobytes()
    raw = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, cols * samples, kind.itemsize).transpose(0, 2, 1).reshape(rows, -1, samples if samples > 1 else 1)
    x = np.ascontiguousarray(raw).copy()
    x[:, 1:] -= raw[:, :-1]
    return x.tobytes()


def tiff(grid, order="<", compression=1, predictor=1, tile=None, strip=None, last=False):
    grid = grid if grid.ndim == 3 else grid[:, :, None]
    height, width, samples = grid.shape
    bh, bw = tile or (strip or height, width)
    blocks = []
    for r in range(0, height, bh):
        for c in range(0, width, bw):
            part = grid[r : r + bh, c : c + bw]
            if tile:
                part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
            raw = packed(np.ascontiguousarray(part), predictor, order)
            blocks.append(raw if compression == 1 else zlib.compress(raw) if compression in (8, 32946) else lzw(raw))
    form = {"f": 3, "u": 1, "i": 2}[grid.dtype.kind]
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [grid.dtype.itemsize * 8] * samples), 259: ("H", [compression]), 262: ("H", [1]), 277: ("H", [samples]), 317: ("H", [predictor]), 339: ("H", [form] * samples), 33550: ("d", [30.0, 20.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 5.0, 7.0, 0.0])}
    tags |= {322: ("I", [bw]), 323: ("I", [bh]), 324: ("I", None), 325: ("I", [len(b) for b in blocks])} if tile else {278: ("I", [bh]), 273: ("I", None), 279: ("I", [len(b) for b in blocks])}
    where = [8 + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    ifd = 8 + sum(map(len, blocks))
    entries, extra, at = b"", b"", ifd + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        values = where if values is None else values
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        field = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[kind], len(values)) + field
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, ifd) + b"".join(blocks) + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra


rng = np.random.default_rng(0)
SMOOTH = np.add.outer(np.arange(70), np.arange(45)).astype("f4") / 7
NOISE = rng.normal(size=(70, 45)).astype("f4")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32946])
@pytest.mark.parametrize("layout", [{}, {"strip": 16}, {"tile": (32, 16)}])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_all_layouts(order, compression, layout, predictor):
    for grid in (SMOOTH, NOISE, NOISE.astype("f8")):
        got, meta = geotiff.decode(tiff(grid, order, compression, predictor, **layout))
        assert np.array_equal(got, grid.astype("f4")) and meta.transform == (5.0, 7.0, 30.0, -20.0)
    if predictor < 3:
        whole = rng.integers(0, 60000, (33, 21)).astype("u2")
        assert np.array_equal(geotiff.decode(tiff(whole, order, compression, predictor, **layout))[0], whole.astype("f4"))


def test_the_first_of_several_samples():
    both = np.stack([SMOOTH, NOISE], axis=2)
    for layout in ({"strip": 9}, {"tile": (16, 16)}):
        assert np.array_equal(geotiff.decode(tiff(both, compression=8, predictor=2, **layout))[0], SMOOTH)


def test_damaged_files():
    good = tiff(SMOOTH, compression=8, tile=(32, 32))
    for bad in (good[:100], good[:8], b"", b"MM\0*", good.replace(b"\x78\x9c", b"\0\0", 1)):
        with pytest.raises(RasterError):
            geotiff.decode(bad)
    with pytest.raises(UnsupportedFormat):
        geotiff.decode(tiff(SMOOTH, compression=1)[:2] + struct.pack("<HI", 43, 8) + bytes(100))
    huge = bytearray(tiff(np.zeros((2, 2), "f4"), strip=2))
    at = huge.index(struct.pack("<HHI", 256, 4, 1)) + 8
    huge[at : at + 4] = struct.pack("<I", 1 << 30)
    with pytest.raises(RasterError):
        geotiff.decode(bytes(huge))


def test_headers_and_pixels_of_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(SMOOTH, compression=8, tile=(32, 32)))
    (tmp_path / "b.tif").write_bytes(tiff(NOISE, ">", 5, 3, strip=8))
    paths = [str(tmp_path / n) for n in ("a.tif", "b.tif")]
    assert geotiff.same_shape(geotiff.headers(spark, paths)) == (70, 45)
    rows = geotiff.read(spark, paths, "v").collect()
    for k, grid in enumerate((SMOOTH, NOISE)):
        got = np.zeros((70, 45), "f4")
        for r in rows:
            if r["layer"] == k:
                got[r["row"], r["col"]] = r["v"]
        assert np.array_equal(got, grid)
    with pytest.raises(StackIOError):
        geotiff.headers(spark, [str(tmp_path / "none.tif")])


def test_tasks_write_files(spark, tmp_path):
    assert files.writer(spark, str(tmp_path)) and files.writer(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(0, 0, "x", 1.0), (1, 1, "x", 2.0), (0, 1, "y", None)], "row int, col int, name string, v double")
    got = geotiff.write_layers(rows, "name", "v", (2, 2), Meta(), f"{tmp_path}/new/deep")
    assert [p.rpartition("/")[2] for p in got] == ["x.tif", "y.tif"] and sorted(p.name for p in (tmp_path / "new/deep").iterdir()) == ["x.tif", "y.tif"]
    assert np.array_equal(geotiff.decode((tmp_path / "new/deep/x.tif").read_bytes())[0], np.array([[1, np.nan], [np.nan, 2]], "f4"), equal_nan=True)
