"""Chunked files: ranges against whole arrays, what is read of the file, damaged files, and products as a stack."""

import numpy as np
import pytest

from fringeflow.errors import DimensionMismatch, MetadataError, RasterError
from fringeflow.sources import hdf5

rng = np.random.default_rng(0)


@pytest.mark.parametrize("kind", ["<f4", ">f4", "<f8", "<i2", "|u1", "<i4"])
@pytest.mark.parametrize("chunks", [None, (7, 9), (64, 64), (1, 53), (3, 3)])
def test_ranges(kind, chunks):
    x = (rng.normal(size=(60, 53)) * 50).astype(kind)
    data = hdf5.encode({"a/b/x": (x, chunks), "a/y": (np.arange(5.0), None), "z": (np.arange(40, dtype="<i8"), (6,))})
    read = []

    def fetch(at, n):
        read.append(n)
        return data[at : at + n]

    d = hdf5.Dataset(fetch, "a/b/x")
    assert d.shape == (60, 53) and d.kind == np.dtype(kind) and np.array_equal(d.read(), x.astype(float))
    for low, high in (([0, 0], [1, 1]), ([5, 8], [22, 40]), ([59, 52], [60, 53]), ([10, 0], [10, 5])):
        read.clear()
        assert np.array_equal(d.read(low, high), x[low[0] : high[0], low[1] : high[1]].astype(float))
        assert sum(read) < len(data)
    assert hdf5.Dataset(fetch, "/a/y").read().tolist() == list(range(5))
    assert hdf5.Dataset(fetch, "z").read([7], [20]).tolist() == list(range(7, 20))


def test_damaged_files():
    data = hdf5.encode({"g/x": (np.arange(100.0).reshape(10, 10), (4, 4))})
    fetch = lambda d: lambda at, n: d[at : at + n]
    with pytest.raises(RasterError):
        hdf5.Dataset(fetch(b"no file" * 20), "x")
    with pytest.raises(MetadataError):
        hdf5.Dataset(fetch(data), "g/none")
    with pytest.raises(MetadataError):
        hdf5.Dataset(fetch(data), "g/x/deeper")
    with pytest.raises(RasterError):
        hdf5.Dataset(fetch(data), "g")
    with pytest.raises(RasterError):
        hdf5.Dataset(fetch(data.replace(b"\x78\x9c", b"\0\0")), "g/x").read()


def product(d, name, shift=0, n=12, baseline=5.0):
    lon, lat = -71 + 0.01 * (np.arange(n) + shift), -36 - 0.01 * np.arange(n + 2)
    r, c = np.indices((n + 2, n))
    c = c + shift
    phase = (r * 100 + c).astype("<f4")
    grids = {hdf5.PHASE: (phase, (5, 4)), hdf5.COHERENCE: ((c / 100).astype("<f4"), (5, 4)), hdf5.COMPONENTS: ((c % 5).astype("<i2"), (14, 3)), hdf5.LONGITUDE: (lon, None), hdf5.LATITUDE: (lat, (4,)), hdf5.BASELINE: (np.full((2, 2, 2), baseline, "<f4"), (1, 2, 2))}
    path = d / f"S1-GUNW-A-R-018-tops-{name}-x.nc"
    path.write_bytes(hdf5.encode(grids))
    return str(path)


def test_products_as_a_stack(spark, tmp_path):
    paths = [product(tmp_path, "20240113_20240101"), product(tmp_path, "20240125_20240101", 2, 16, -3.0), product(tmp_path, "20240125_20240113", 40)]
    stack, left = hdf5.read_products(spark, paths, (-70.965, -36.085, -70.905, -36.015))
    assert left == [paths[2]] and [str(e) for e in stack.epochs] == ["2024-01-01", "2024-01-13", "2024-01-25"] and stack.shape == (7, 6)
    assert [(p.ref, p.sec, p.perp_baseline_m) for p in stack.pairs] == [(0, 1, 5.0), (0, 2, -3.0)]
    assert stack.meta.transform == pytest.approx((-70.96, -36.02, 0.01, -0.01))
    rows = stack.px.collect()
    assert len(rows) == 42
    for x in rows:
        r, c = x["row"] + 2, x["col"] + 4
        assert x["phase"] == ([None, None] if c % 5 == 0 else [r * 100 + c] * 2) and x["coh"] == pytest.approx([c / 100] * 2)
    with pytest.raises(DimensionMismatch):
        hdf5.read_products(spark, paths, (0, 0, 1, 1))
    with pytest.raises(MetadataError):
        hdf5.dates_of("a.nc")
