"""Whole runs on small synthetic scenes: files in, products out."""

import json
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeflow import cli
from fringeflow.errors import InversionError, MetadataError, StackIOError
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators import decompose, filters, inversion, troposphere
from fringeflow.operators.cube import Meta, Pair, Series, Stack, every
from fringeflow.plans import pipeline
from fringeflow.sources import geotiff, isce, manifest

EPOCHS = every(date(2021, 1, 1), 12, 6)
PAIRS = tuple(Pair(i, j, 10.0 * (j - i)) for i in range(6) for j in range(i + 1, min(6, i + 3)))
ROWS = COLS = 16
R, C = np.indices((ROWS, COLS))
BOWL = -0.06 * np.exp(-((R - 8) ** 2 + (C - 8) ** 2) / (2 * 4.0**2))
YEARS = np.array([(e - EPOCHS[0]).days / 365.25 for e in EPOCHS])


def phase(p):
    return -4 * np.pi / WAVELENGTH_M * BOWL * (YEARS[p.sec] - YEARS[p.ref])


def grid(df, value, shape=(ROWS, COLS)):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


@pytest.fixture(scope="module")
def stack_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("stack")
    meta = Meta((500.0, 7000.0, 30.0, -30.0), "EPSG:32719")
    rng = np.random.default_rng(0)
    ifgs, amps, cohs = [], [], []
    for k, p in enumerate(PAIRS):
        z = np.exp(1j * phase(p))
        for part, x in (("re", z.real), ("im", z.imag)):
            (d / f"ifg_{k}_{part}.tif").write_bytes(geotiff.encode(x, meta))
        ifgs.append({"reference": p.ref, "secondary": p.sec, "perp_baseline_m": p.perp_baseline_m, "file": f"ifg_{k}.tif"})
        coh = np.full((ROWS, COLS), 0.7)
        coh[0, 0] = 0.9
        (d / f"coh_{k}.tif").write_bytes(geotiff.encode(coh, meta))
        cohs.append(f"coh_{k}.tif")
    for e in range(6):
        a = 1 + 0.01 * rng.normal(size=(ROWS, COLS))
        a[1, 1] = 1 if e % 2 else 9
        (d / f"amp_{e}.tif").write_bytes(geotiff.encode(a, meta))
        amps.append(f"amp_{e}.tif")
    (d / "stack.json").write_text(json.dumps({"wavelength_m": WAVELENGTH_M, "incidence_deg": 39.0, "epochs": [e.isoformat() for e in EPOCHS], "ifgs": ifgs, "amplitudes": amps, "coherence": cohs}))
    return d


def test_run_sbas(spark, stack_dir, tmp_path):
    got = pipeline.run_sbas(spark, str(stack_dir), pipeline.SbasConfig(aps_window=1, ps_threshold=0.4))
    v = grid(got.velocity, "velocity")
    assert v[8, 8] == pytest.approx(-0.06, abs=0.005) and abs(v[0, 15]) < 0.005 and np.isnan(v[1, 1])
    assert np.nanmin(grid(got.temporal_coherence, "temporal_coherence")) > 0.99
    assert got.lost_pairs == 0 and got.flags.where("corrected or detected").count() == 0
    pipeline.write(got, str(tmp_path))
    back, meta, shape = manifest.read_map(spark, str(tmp_path / "velocity.tif"), Meta())
    assert shape == (ROWS, COLS) and meta.crs == "EPSG:32719" and np.allclose(grid(back, "velocity"), v, atol=1e-6, equal_nan=True)
    series = manifest.read_series(spark, str(tmp_path / "series"), Meta())
    assert series.epochs == EPOCHS and np.allclose(grid(inversion.velocity(series), "velocity"), v, atol=1e-5, equal_nan=True)


def test_cli(spark, stack_dir, tmp_path, capsys):
    assert cli.main(["info", str(stack_dir)], spark) == 0 and "pairs 9" in capsys.readouterr().out
    assert cli.main(["network", str(stack_dir)], spark) == 0 and "connected" in capsys.readouterr().out
    assert cli.main(["ps", str(stack_dir)], spark) == 0 and f"{ROWS * COLS - 1} candidates" in capsys.readouterr().out
    out = str(tmp_path / "run")
    assert cli.main(["run", str(stack_dir), out, "--ref-row", "0", "--ref-col", "0"], spark) == 0
    assert cli.main(["features", f"{out}/series", str(tmp_path / "f"), "--no-seasonal", "--csv"], spark) == 0
    assert (tmp_path / "f/velocity.tif").exists() and not (tmp_path / "f/seasonal_phase.tif").exists()
    assert next((tmp_path / "f/features.csv").glob("part-*")).read_text().startswith("x,y,velocity")
    assert cli.main(["deramp", f"{out}/series", str(tmp_path / "d"), "linear"], spark) == 0
    assert cli.main(["tropo-era5", f"{out}/series", f"{out}/series", str(tmp_path / "t")], spark) == 0
    assert cli.main(["decompose", f"{out}/velocity.tif", f"{out}/velocity.tif", str(tmp_path / "ud"), "--asc-incidence-deg", "39", "--asc-heading-deg", "-12", "--desc-incidence-deg", "39", "--desc-heading-deg", "-168"], spark) == 0
    assert {p.name for p in (tmp_path / "ud").glob("*.tif")} == {"up.tif", "east.tif"}
    assert cli.main(["info", str(tmp_path)], spark) == 1
    for bad in (["--ref-row", "1"], ["--ref-region", "3", "0", "1", "5"], ["--ref-region", "0", "0", "1", "1", "--ref-row", "0", "--ref-col", "0"]):
        with pytest.raises(SystemExit):
            cli.main(["run", str(stack_dir), out, *bad], spark)


def test_manifest_errors(spark, stack_dir, tmp_path):
    with pytest.raises(StackIOError):
        manifest.load(spark, str(tmp_path))
    good = json.loads((stack_dir / "stack.json").read_text())
    for change in ({"wavelength_m": -1}, {"epochs": []}, {"epochs": ["2021-01-02", "2021-01-01"]}, {"epochs": ["x"]}, {"ifgs": [{"reference": 0}]}):
        (tmp_path / "stack.json").write_text(json.dumps(good | change))
        with pytest.raises(MetadataError):
            manifest.load(spark, str(tmp_path))
    (tmp_path / "stack.json").write_text(json.dumps({k: v for k, v in good.items() if k != "coherence"}))
    assert manifest.read_coherence(spark, str(tmp_path)) is None
    with pytest.raises(StackIOError, match="ifg_0_re.tif"):
        manifest.read_interferograms(spark, str(tmp_path))


@pytest.fixture(scope="module")
def isce_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("isce")

    def vrt(path: Path, bands):
        xml = "".join(f'<VRTRasterBand dataType="{t}" band="{k + 1}" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="1">{path.name}</SourceFilename><ByteOrder>LSB</ByteOrder><ImageOffset>{o}</ImageOffset><PixelOffset>{px}</PixelOffset><LineOffset>{ln}</LineOffset></VRTRasterBand>' for k, (t, o, px, ln) in enumerate(bands))
        path.with_name(path.name + ".vrt").write_text(f'<VRTDataset rasterXSize="{COLS}" rasterYSize="{ROWS}">{xml}</VRTDataset>')

    for p in PAIRS:
        name = f"{EPOCHS[p.ref]:%Y%m%d}_{EPOCHS[p.sec]:%Y%m%d}"
        f = d / "ifgs" / name
        f.mkdir(parents=True)
        amp = np.ones((ROWS, COLS))
        amp[2, 3] = 0
        (f / "filt_fine.unw").write_bytes(np.stack([amp, phase(p)], axis=1).astype("<f4").tobytes())
        vrt(f / "filt_fine.unw", [("Float32", 0, 4, 8 * COLS), ("Float32", 4 * COLS, 4, 8 * COLS)])
        (f / "filt_fine.cor").write_bytes(np.full((ROWS, COLS), 0.8, "<f4").tobytes())
        vrt(f / "filt_fine.cor", [("Float32", 0, 4, 4 * COLS)])
        (f / "filt_fine.int").write_bytes((amp * np.exp(1j * phase(p))).astype("<c8").tobytes())
        vrt(f / "filt_fine.int", [("CFloat32", 0, 8, 8 * COLS)])
        (f / "filt_fine.unw.conncomp").write_bytes(amp.astype("u1").tobytes())
        vrt(f / "filt_fine.unw.conncomp", [("Byte", 0, 1, COLS)])
        b = d / "baselines" / name
        b.mkdir(parents=True)
        (b / "x.txt").write_text(f"junk\nBperp (average): {p.perp_baseline_m - 1}\nBperp (average): {p.perp_baseline_m + 1}\n")
    los = np.zeros((ROWS, 2, COLS), "<f4")
    los[:, 0], los[:, 1] = 39, 100
    los[0, :, 0] = 0
    (d / "los.rdr").write_bytes(los.tobytes())
    vrt(d / "los.rdr", [("Float32", 0, 4, 8 * COLS), ("Float32", 4 * COLS, 4, 8 * COLS)])
    return d


def test_isce(spark, isce_dir, tmp_path):
    files = isce.IsceConfig(baselines=str(isce_dir / "baselines"))
    stack = isce.read_unwrapped(spark, str(isce_dir / "ifgs"), files)
    assert stack.pairs == PAIRS and stack.epochs == EPOCHS and stack.shape == (ROWS, COLS)
    got = pipeline.run_sbas_isce(spark, str(isce_dir / "ifgs"), pipeline.SbasConfig(solver=pipeline.Solver("variance")), files)
    v = grid(got.velocity, "velocity")
    assert np.isnan(v[2, 3]) and np.allclose(np.delete(v.ravel() - v[0, 0], 2 * COLS + 3), np.delete((BOWL - BOWL[0, 0]).ravel(), 2 * COLS + 3), atol=1e-4)
    assert got.velocity_std is not None
    rows, *_ = isce.read_wrapped(spark, str(isce_dir / "ifgs"))
    assert rows.where("re is null").count() == len(PAIRS)
    assert isce.read_components(spark, str(isce_dir / "ifgs")).where("component = 0").count() == len(PAIRS)
    los = isce.read_los(spark, str(isce_dir / "los.rdr"))
    assert los.where("incidence_deg is null").count() == 1 and los.count() == ROWS * COLS
    assert cli.main(["isce", str(isce_dir / "ifgs"), str(tmp_path), "--deramp", "linear", "--dem-error-range", "850000", "--baselines", str(isce_dir / "baselines")], spark) == 0
    assert (tmp_path / "dem_error.tif").exists() and (tmp_path / "velocity_std.tif").exists()
    with pytest.raises(MetadataError):
        isce.pair_folders(spark, str(isce_dir / "baselines" / f"{EPOCHS[0]:%Y%m%d}_{EPOCHS[1]:%Y%m%d}"))


def test_raw_cube(spark, tmp_path):
    cube = np.stack([phase(p) for p in PAIRS]).astype("<f4")
    cube[0, 1, 2] = np.nan
    (tmp_path / "phase.f32").write_bytes(cube.tobytes())
    (tmp_path / "meta.json").write_text(json.dumps({"wavelength_m": WAVELENGTH_M, "incidence_deg": 39, "n_epochs": 6, "n_pairs": len(PAIRS), "rows": ROWS, "cols": COLS, "epochs": [e.isoformat() for e in EPOCHS], "pairs": [[p.ref, p.sec] for p in PAIRS]}))
    got = manifest.read_raw_cube(spark, str(tmp_path)).px.select("row", "col", F.col("phase")[0].alias("x"))
    assert np.allclose(grid(got, "x"), cube[0], equal_nan=True)


def series(spark, cube, epochs=EPOCHS):
    n, rows, cols = cube.shape
    data = [(r, c, [None if np.isnan(x) else float(x) for x in cube[:, r, c]]) for r in range(rows) for c in range(cols)]
    return Series(spark.createDataFrame(data, "row int, col int, disp array<double>"), epochs, (rows, cols))


def test_ramp_with_mask(spark):
    r, c = np.indices((20, 20))
    cube = np.stack([3.0 * c - 2.0 * r + 1] * 6)
    cube[:, :4, :4] += 50
    s = series(spark, cube)
    s = s.with_px(s.px.withColumn("fit", ~((F.col("row") < 4) & (F.col("col") < 4))))
    got = grid(filters.deramp(s, mask="fit").px.withColumn("x", F.col("disp")[2]), "x", (20, 20))
    assert np.abs(got[4:, 4:]).max() < 1e-3 and np.allclose(got[:4, :4], 50, atol=1e-3)
    with pytest.raises(InversionError):
        filters.deramp(s.with_px(s.px.withColumn("fit", F.col("row") + F.col("col") == 0)), mask="fit")


def test_topography_second_degree(spark):
    r, c = np.indices((12, 12))
    h = (r + c) * 250.0
    z = (h - h.mean()) / np.abs(h - h.mean()).max()
    s = series(spark, np.stack([0.5 * z + 2 * z * z + 5] * 6))
    s = s.with_px(s.px.withColumn("height_m", (F.col("row") + F.col("col")) * 250.0))
    got = grid(filters.correct_topography(s, 2).px.withColumn("x", F.col("disp")[0]), "x", (12, 12))
    assert np.ptp(got) < 1e-3


def test_aps_passes_lines_and_takes_out_an_artefact(spark):
    r, c = np.indices((14, 14))
    line = np.stack([1e-3 * (r + c) * e for e in range(9)])
    epochs = every(date(2021, 1, 1), 12, 9)
    out = filters.correct_aps(series(spark, line, epochs), 2.0, 5)
    assert np.abs(grid(out.px.withColumn("x", F.col("disp")[4]), "x", (14, 14)) - line[4]).max() < 1e-6
    bad = line.copy()
    bad[4] += 0.01 + 0.001 * r
    bad[1, 2, 3] = np.nan
    got = grid(filters.correct_aps(series(spark, bad, epochs), 2.0, 7).px.withColumn("x", F.col("disp")[4]), "x", (14, 14))
    left = np.abs(got - line[4])
    assert left[2, 3] == pytest.approx(0.012) and np.delete(left.ravel(), 2 * 14 + 3).mean() < 0.012


def test_tiles_do_not_show(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 25))
    rows = spark.createDataFrame([(r, c, 0, float(x[r, c])) for r in range(30) for c in range(25)], "row int, col int, e int, v double")
    from fringeflow.operators.kernels import low_pass

    got = grid(filters.low_pass(rows, "e", "v", 1.5, tile=8), "v", (30, 25))
    assert np.allclose(got, low_pass(x, 1.5))


def test_profile_and_zenith_delay(spark):
    z = np.arange(15) * 1000.0
    level = [tuple(map(float, (h, 1013.25 * np.exp(-h / 8000), 288.15 - 0.0065 * h, 0.012 * np.exp(-h / 2000)))) for h in z]
    df = spark.createDataFrame([(level[::-1], 500.0), ([(a, b, c, 0.0) for a, b, c, _ in level], 500.0)], f"p array<{troposphere.LEVEL}>, h double")
    got = df.select(troposphere.interpolate(F.col("p"), F.col("h")).alias("l"), troposphere.zenith_wet(F.col("p"), F.col("h")).alias("w")).collect()
    assert got[0]["l"]["pressure_hpa"] == pytest.approx(1013.25 * np.exp(-500 / 8000)) and got[0]["l"]["temperature_k"] == pytest.approx(288.15 - 3.25)
    assert 0.02 < got[0]["w"] < 0.4 and got[1]["w"] == 0
    zhd = spark.range(1).select(troposphere.saastamoinen_zhd(F.lit(1013.25), F.lit(45.0), F.lit(0.0))).first()[0]
    assert zhd == pytest.approx(2.3068, abs=1e-3)


def test_decompose_recovers_motion(spark):
    asc, desc = (39.0, -12.0), (39.0, -168.0)
    rows = []
    for r in range(4):
        for c in range(4):
            up, east = 0.1 + 0.01 * r - 0.005 * c, -0.04 + 0.003 * c
            rows.append((r, c, *(up * np.cos(np.radians(i)) - east * np.sin(np.radians(i)) * np.cos(np.radians(h)) for i, h in (asc, desc))))
    df = spark.createDataFrame([tuple(float(x) if k > 1 else x for k, x in enumerate(r)) for r in rows], "row int, col int, a double, d double")
    got = decompose.decompose_asc_desc(df, "a", "d")
    r, c = np.indices((4, 4))
    assert np.allclose(grid(got, "up", (4, 4)), 0.1 + 0.01 * r - 0.005 * c, atol=1e-9) and np.allclose(grid(got, "east", (4, 4)), -0.04 + 0.003 * c, atol=1e-9)
    with pytest.raises(InversionError):
        decompose.decompose(df, ["a", "d"], [asc, asc])
    same = df.withColumn("i", F.lit(39.0)).withColumn("h", F.lit(-12.0))
    assert decompose.decompose_per_pixel(same, ["a", "d"], ["i", "i"], ["h", "h"]).where("up is not null").count() == 0


def test_inversion_errors(spark):
    px = spark.createDataFrame([(0, 0, [0.1, 0.2])], "row int, col int, phase array<double>")
    with pytest.raises(ValueError):
        inversion.invert(Stack(px, EPOCHS[:4], (Pair(0, 1), Pair(2, 3)), (1, 1)))
    good = Stack(px, EPOCHS[:3], (Pair(0, 1), Pair(1, 2)), (1, 1))
    with pytest.raises(InversionError):
        inversion.invert(good, "variance")
    with pytest.raises(ValueError):
        inversion.reference_to_pixel(good, 5, 0)
    assert inversion.invert(good, candidates=px.where("row = 1").select("row", "col")).px.count() == 0
