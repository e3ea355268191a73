"""Rasters by blocks: pushed-down filters, partial reads, sparse and large files, and writing that leaves a whole file or none."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow.errors import StackIOError
from fringeflow.operators.cube import Meta
from fringeflow.sources import files, geotiff, raster
from test_geotiff import NOISE, SMOOTH, tiff

META = Meta((500.0, 7000.0, 30.0, -30.0), "EPSG:32719")


def grid_of(rows, shape, value="v", layer=0):
    out = np.full(shape, np.nan)
    for r in rows:
        if r["layer"] == layer and r[value] is not None:
            out[r["row"], r["col"]] = r[value]
    return out


class Counted:
    """A file's bytes, and how many of them were asked for."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def __call__(self, at, n):
        self.read += n
        return self.data[at : at + n]


@pytest.mark.parametrize("layout", [{}, {"strip": 8}, {"tile": (16, 16)}])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_ranges_read_only_their_blocks(layout, compression):
    data = tiff(NOISE, "<", compression, 2, **layout) if compression > 1 else tiff(NOISE, **layout)
    for r0, r1, c0, c1 in ((0, 70, 0, 45), (10, 12, 0, 45), (15, 33, 7, 41), (69, 70, 44, 45)):
        fetch = Counted(data)
        image = geotiff.Image(fetch, len(data))
        before = fetch.read
        assert np.array_equal(image.read(r0, r1, c0, c1), NOISE[r0:r1, c0:c1])
        if layout or compression == 1:
            assert fetch.read - before < len(data) or (r0, r1) == (0, 70)
    if compression == 1 and not layout:
        fetch = Counted(data)
        image = geotiff.Image(fetch, len(data))
        before = fetch.read
        image.read(10, 12)
        assert fetch.read - before == 2 * 45 * 4


def test_blocks_and_pushed_filters(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(SMOOTH, compression=8, tile=(16, 16)))
    (tmp_path / "b.tif").write_bytes(tiff(NOISE, strip=5))
    layers = raster.tiffs(spark, [str(tmp_path / n) for n in ("a.tif", "b.tif")])
    df = raster.scan(spark, layers, ["v"], block=400)
    assert df.rdd.getNumPartitions() > 12
    rows = df.collect()
    assert np.array_equal(grid_of(rows, (70, 45)), SMOOTH) and np.array_equal(grid_of(rows, (70, 45), layer=1), NOISE) and len(rows) == 2 * 70 * 45
    for condition, most in (("layer = 1", 10), ("layer = 0 and row between 20 and 22", 3), ("row >= 69 and col < 3", 2), ("layer in (1) and row = 7", 1), ("row > 100", 1)):
        part = df.where(condition)
        assert part.rdd.getNumPartitions() <= most, condition
        assert sorted(part.collect()) == sorted(r for r in rows if eval(condition.replace(" = ", " == ").replace("between 20 and 22", "in (20, 21, 22)").replace("(1)", "(1,)"), {}, r.asDict()))  # noqa: S307
    with pytest.raises(StackIOError):
        raster.tiffs(spark, [str(tmp_path / "none.tif")])


def test_raw_bands_of_several_files(spark, tmp_path):
    (tmp_path / "amp.bin").write_bytes(b"head" + SMOOTH.astype("<f4").tobytes())
    z = (NOISE + 1j * SMOOTH).astype(">c8")
    (tmp_path / "z.bin").write_bytes(z.tobytes())
    uri = f"file://{tmp_path}"
    layer = raster.raw((70, 45), [{"uri": f"{uri}/amp.bin", "type": "<f4", "offset": 4, "pixel": 4, "line": 180}, {"uri": f"{uri}/z.bin", "type": ">c8", "offset": 0, "pixel": 8, "line": 360}])
    df = raster.scan(spark, [layer], ["v", "re", "im"], block=450)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 7
    for value, expected in (("v", SMOOTH), ("re", NOISE), ("im", SMOOTH)):
        assert np.array_equal(grid_of(rows, (70, 45), value), expected)
    short = raster.raw((71, 45), layer["bands"])
    with pytest.raises(Exception, match="fewer"):
        raster.scan(spark, [short], ["v", "re", "im"]).count()


@pytest.mark.parametrize("big", [None, True])
def test_tiles_written_by_tasks(spark, tmp_path, big):
    rows = [(r, c, n, None if (r + c) % 9 == 0 else float(r * 100 + c + k)) for k, n in enumerate(("x", "y")) for r in range(0, 50) for c in range(0, 70) if n == "x" or (r < 16 and c >= 64)]
    df = spark.createDataFrame(rows, "row int, col int, n string, v double").repartition(5)
    got = raster.write_tiles(df, "n", "v", (50, 70), META, str(tmp_path / "out"), tile=16, big=big)
    assert got == [f"{tmp_path}/out/{n}.tif" for n in ("x", "y")] and sorted(os.listdir(tmp_path / "out")) == ["x.tif", "y.tif"]
    magic = struct.unpack("<H", (tmp_path / "out/x.tif").read_bytes()[2:4])[0]
    assert magic == (43 if big else 42)
    for k, n in enumerate(("x", "y")):
        data = (tmp_path / f"out/{n}.tif").read_bytes()
        grid, meta = geotiff.decode(data)
        want = np.full((50, 70), np.nan)
        for r, c, name, v in rows:
            if name == n and v is not None:
                want[r, c] = v
        assert np.array_equal(grid, want.astype("f4"), equal_nan=True) and (meta.transform, meta.crs) == (META.transform, META.crs)
    back = geotiff.read(spark, got, "v").collect()
    assert len(back) == 2 * 50 * 70 and sum(r["v"] is not None for r in back) == sum(v is not None for *_, v in rows)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.lit("m").alias("n"), F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(Exception, match="lost"):
        raster.write_tiles(df, "n", "v", (25, 40), Meta(), str(tmp_path / "out"), tile=16)
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="outside"):
        raster.write_tiles(spark.createDataFrame([(0, 40, "m", 1.0)], "row int, col int, n string, v double"), "n", "v", (25, 40), Meta(), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []


def test_no_rows_no_files(spark, tmp_path):
    none = spark.createDataFrame([], "row int, col int, n string, v double")
    assert raster.write_tiles(none, "n", "v", (25, 40), Meta(), str(tmp_path / "out")) == []


def test_files_are_told_apart_by_their_whole_path(spark, tmp_path):
    paths = []
    for k, d in enumerate(("a", "x/a")):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f.bin").write_bytes(bytes([k + 1]))
        paths.append(f"{tmp_path}/{d}/f.bin")
    paths += [paths[0], f"file://{paths[1]}"]
    rows = files.pixels_of(spark, paths, lambda p, data: [np.array([[data[0]]], float)], ["v"]).collect()
    assert sorted((r["layer"], r["v"]) for r in rows) == [(0, 1.0), (1, 2.0), (2, 1.0), (3, 2.0)]


def test_stores_without_a_client_are_read_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff(SMOOTH))
    monkeypatch.setattr(raster, "store_uri", lambda *_: None)
    assert geotiff.headers(spark, [str(tmp_path / "a.tif")])[0][0] == (70, 45)
    assert np.array_equal(grid_of(geotiff.read(spark, [str(tmp_path / "a.tif")], "v").collect(), (70, 45)), SMOOTH)


def test_isce_bands_each_from_its_own_file(spark, tmp_path):
    """Amplitude and phase in files of their own, one named by its whole path, and big-endian."""
    from fringeflow.sources import isce

    amp, phase = np.full((6, 5), 7, "<f4"), np.arange(30, dtype=">f4").reshape(6, 5)
    amp[2, 3] = 0
    other = tmp_path / "elsewhere"
    other.mkdir()
    for name in ("20240101_20240113", "20240113_20240125"):
        d = tmp_path / "pairs" / name
        d.mkdir(parents=True)
        (d / "a.bin").write_bytes(amp.tobytes())
        (other / f"{name}.bin").write_bytes(b"12345678" + phase.tobytes())
        band = '<VRTRasterBand dataType="Float32" band="{}" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="{}">{}</SourceFilename><ByteOrder>{}</ByteOrder><ImageOffset>{}</ImageOffset></VRTRasterBand>'
        bands = band.format(1, 1, "a.bin", "LSB", 0) + band.format(2, 0, f"{other}/{name}.bin", "MSB", 8)
        (d / "filt_fine.unw.vrt").write_text(f'<VRTDataset rasterXSize="5" rasterYSize="6">{bands}</VRTDataset>')
    stack = isce.read_unwrapped(spark, str(tmp_path / "pairs"))
    rows = stack.px.collect()
    assert len(rows) == 30 and len(stack.pairs) == 2
    for r in rows:
        want = None if (r["row"], r["col"]) == (2, 3) else float(phase[r["row"], r["col"]])
        assert r["phase"] == [want, want]
