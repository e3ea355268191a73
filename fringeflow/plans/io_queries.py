"""Registered queries over files: products are written to the shared folder in each format, read back, and compared with what SQL says they hold."""

from __future__ import annotations

import json
import math
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import MetadataError
from fringeflow.operators import features as FE
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators import inversion, unwrapping
from fringeflow.operators.cube import Meta, Pair, Series, Stack, to_long, years
from fringeflow.plans import fixtures as X
from fringeflow.plans import pipeline
from fringeflow.plans.queries import _DIGITS, _FEAT, _LINEAR, _NAMES, query, r, rs
from fringeflow.sources import geotiff, hdf5, isce, manifest
from fringeflow.sources.files import write_bytes, writer
from fringeflow.store import new_path

#: Pairs of the file fixtures.
_PAIRS = (Pair(0, 1, 12.5), Pair(1, 2, -20.0), Pair(0, 2, -7.5))
_META = Meta((500000.0, 7000000.0, 30.0, -30.0), "EPSG:32719")
_LAYERS = 'px AS (SELECT DISTINCT "row", col FROM s), k AS (SELECT unnest(range(0, 3))::INT AS k)'


def _long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """Rows of (row, col, k) for three layers over the pixels there are, and the grid's shape."""
    px = X.long_series(spark, sf_dir).select("row", "col").distinct()
    return px.select("row", "col", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")), X.shape(px)


# --- GeoTIFF stacks ---

_RE, _IM = '("row" * 7 + col * 3 + k) % 11 - 5.5', '("row" + col * 5 + k * 2) % 13 - 6.25'


@query(f"""WITH {X.series_sql()}, {_LAYERS} SELECT 'interferogram' AS what, k AS layer, "row", col, {rs(f'({_RE})', 'a')}, {rs(f'({_IM})', 'b')} FROM px, k
UNION ALL SELECT 'amplitude', k, "row", col, ("row" * 3 + col + k) % 17 + 0.5, NULL FROM px, k UNION ALL SELECT 'coherence', k, "row", col, (("row" + col + k) % 8) / 8.0, NULL FROM px, k""")
def geotiff_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack.json with real and imaginary parts, amplitudes and coherence, written as GeoTIFF and read back."""
    rows, shape = _long(spark, sf_dir)
    row, col, k = F.col("row"), F.col("col"), F.col("k")
    folder = new_path(spark, "stack")
    kinds = {"ifg_re": (row * 7 + col * 3 + k) % 11 - 5.5, "ifg_im": (row + col * 5 + k * 2) % 13 - 6.25, "amp": (row * 3 + col + k) % 17 + 0.5, "coh": (row + col + k) % 8 / 8.0}
    name = {"ifg_re": F.format_string("ifg_%d_re", k), "ifg_im": F.format_string("ifg_%d_im", k), "amp": F.format_string("amp_%d", k), "coh": F.format_string("coh_%d", k)}
    made = [rows.select("row", "col", name[x].alias("name"), v.cast("double").alias("v")) for x, v in kinds.items()]
    for x in made[1:]:
        made[0] = made[0].unionByName(x)
    geotiff.write_layers(made[0], "name", "v", shape, _META, folder)
    stack = Stack(rows, X.EPOCH_DATES[:3], _PAIRS, shape, _META)
    manifest.write_stack_json(spark, folder, stack, amplitudes=[f"amp_{i}.tif" for i in range(3)], coherence=[f"coh_{i}.tif" for i in range(3)])
    ifgs, m, _ = manifest.read_interferograms(spark, folder)
    if (m.meta.transform, m.meta.crs, m.pairs) != (_META.transform, _META.crs, _PAIRS):
        raise MetadataError("the stack's metadata were not read back")
    amps, coh = manifest.read_amplitudes(spark, folder)[0], manifest.read_coherence(spark, folder)[0]
    none = F.lit(None).cast("double")
    out = ifgs.select(F.lit("interferogram").alias("what"), F.col("pair_idx").cast("int").alias("layer"), "row", "col", r(F.col("re")).alias("a"), r(F.col("im")).alias("b"))
    out = out.unionAll(amps.select(F.lit("amplitude"), "epoch_idx", "row", "col", "amplitude", none)).unionAll(coh.select(F.lit("coherence"), "pair_idx", "row", "col", "coh", none))
    return out.where("a is not null")


@query(f"""WITH {X.series_sql()} SELECT 'series' AS what, e AS epoch_idx, "row", col, d::FLOAT::DOUBLE AS value FROM s
UNION ALL SELECT 'velocity', -1, "row", col, round(regr_slope(d, t), 3)::FLOAT::DOUBLE FROM s GROUP BY "row", col HAVING count(*) = {X.EPOCHS}""")
def geotiff_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A velocity map and a series, a file an epoch, written as GeoTIFF and read back: single-precision numbers, gaps as they were."""
    series = X.series(spark, sf_dir, with_shape=True)
    series = Series(series.px, series.epochs, series.shape, _META)
    folder = new_path(spark, "products")
    manifest.write_series(series, f"{folder}/series")
    v = inversion.velocity(series).select("row", "col", F.round("velocity", 3).alias("velocity"))
    geotiff.write_map(v, "velocity", series.shape, _META, f"{folder}/velocity.tif")
    back = manifest.read_series(spark, f"{folder}/series", Meta())
    if (back.epochs, back.meta.transform) != (series.epochs, _META.transform):
        raise MetadataError("the series' metadata were not read back")
    rows, meta, shape = manifest.read_map(spark, f"{folder}/velocity.tif", Meta())
    if (shape, meta.crs) != (series.shape, _META.crs):
        raise MetadataError("the map's metadata were not read back")
    long = to_long(back.px, "epoch_idx", "value", "disp")
    out = long.select(F.lit("series").alias("what"), "epoch_idx", "row", "col", "value")
    return out.unionAll(rows.select(F.lit("velocity"), F.lit(-1), "row", "col", "velocity")).where("value is not null")


@query(f"WITH {_FEAT} SELECT {rs('4000.0 + (col + 0.5) * 30', 'x')}, {rs('9000.0 - (\"row\" + 0.5) * 30', 'y')}, {', '.join(rs(c, c, _DIGITS.get(c, 5)) for c in _NAMES)} FROM q")
def features_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table as CSV with a header, written and read back."""
    path = f"{new_path(spark, 'features')}/features.csv"
    table = FE.to_table(FE.extract(X.series(spark, sf_dir, 1, X.DAILY), _LINEAR), _NAMES, (4000.0, 9000.0, 30.0, -30.0))
    FE.write_csv(table, _NAMES, path)
    got = spark.read.csv(path, header=True, schema=", ".join(f"{c} double" for c in ("x", "y", *_NAMES)))
    return got.select(r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), *(r(F.col(c), _DIGITS.get(c, 5)).alias(c) for c in _NAMES))


# --- ISCE folders and raw cubes ---

_DAYS = tuple(X.FIRST + timedelta(days=12 * i) for i in range(3))
_TYPES = {"f4": "Float32", "c8": "CFloat32", "u1": "Byte"}


def _vrt(spark: SparkSession, path: str, shape: tuple[int, int], kind: str, bands: int, interleave: str = "line") -> None:
    """The description of a raw file: bands line by line, pixel by pixel, or each in a file of its own."""
    (rows, cols), size, name = shape, np.dtype(kind).itemsize, path.rpartition("/")[2]
    pixel, line, step = {"line": (size, bands * cols * size, cols * size), "pixel": (bands * size, bands * cols * size, size), "file": (size, cols * size, 0)}[interleave]
    source = (lambda k: f"{name}.{k}") if interleave == "file" else (lambda _: name)
    xml = "".join(f'<VRTRasterBand dataType="{_TYPES[kind]}" band="{k + 1}" subClass="VRTRawRasterBand"><SourceFilename relativeToVRT="1">{source(k)}</SourceFilename><ByteOrder>LSB</ByteOrder><ImageOffset>{k * step}</ImageOffset><PixelOffset>{pixel}</PixelOffset><LineOffset>{line}</LineOffset></VRTRasterBand>' for k in range(bands))
    write_bytes(spark, path + ".vrt", f'<VRTDataset rasterXSize="{cols}" rasterYSize="{rows}">{xml}</VRTDataset>'.encode())


def _epochs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """A row a pixel: c0 .. c2 and n0 .. n2, cents and events of the first three epochs, 0 where there are none; and the grid's shape."""
    long = X.long_series(spark, sf_dir)
    at = lambda name, e: F.coalesce(F.sum(F.when(F.col("epoch_idx") == e, F.col(name))), F.lit(0)).cast("long")
    return long.groupBy("row", "col").agg(*(at("cents", e).alias(f"c{e}") for e in range(3)), *(at("n", e).alias(f"n{e}") for e in range(3))), X.shape(long)


def _write_raw(files: DataFrame, shape: tuple[int, int], folder: str) -> None:
    """files(name, kind, interleave, row, col, bands ARRAY<DOUBLE>): a task makes each file's bytes; pixels without a row are 0."""
    put_in = {}
    spark = files.sparkSession

    def write(t: pa.Table) -> pa.Table:
        name, kind, interleave = (t[c][0].as_py() for c in ("name", "kind", "interleave"))
        values = np.array(t["bands"].to_pylist(), float)
        grid = np.zeros((*shape, values.shape[1]))
        grid[t["row"].to_numpy(), t["col"].to_numpy()] = values
        at, _, file = name.rpartition("/")
        if kind == "c8":
            made = {file: np.ascontiguousarray(grid.astype("<f4")).view("<c8")}
        elif interleave == "file":
            made = {f"{file}.{k}": grid[:, :, k].astype(kind) for k in range(grid.shape[2])}
        else:
            made = {file: (grid.transpose(0, 2, 1) if interleave == "line" else grid).astype(kind)}
        for f, x in made.items():
            put_in[at](f, np.ascontiguousarray(x).tobytes())
        return pa.table({"name": [name]})

    for at in {r.at for r in files.select(F.regexp_extract("name", "^(.*)/", 1).alias("at")).distinct().collect()}:  # a folder a pair
        put_in[at] = writer(spark, f"{folder}/{at}")
    files.groupBy("name").applyInArrow(write, "name string").collect()


def _isce_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of three pairs over the grid that the pixels span; tasks write its bands from what the table holds."""
    px, shape = _epochs(spark, sf_dir)
    folder, files = new_path(spark, "isce"), []
    c, n = ([F.col(f"{x}{e}") for e in range(3)] for x in "cn")
    for p in _PAIRS:
        at = f"pairs/{_DAYS[p.ref]:%Y%m%d}_{_DAYS[p.sec]:%Y%m%d}"
        cents, events = c[p.sec] - c[p.ref], n[p.ref] + n[p.sec]
        amp = n[p.sec] % 7  # 0 in a seventh of the pixels
        seen = amp > 0
        bands = {
            "filt_fine.unw": ("f4", "line", [amp, cents % 1009 / 8]), "filt_fine.cor": ("f4", "file", [amp, events % 8 / 8]), "filt_fine.unw.conncomp": ("u1", "line", [events % 4]),
            "filt_fine.int": ("c8", "line", [F.when(seen, cents % 9 - 4.5).otherwise(0), F.when(seen, cents % 6 + 0.25).otherwise(0)]),
        }
        for file, (kind, interleave, values) in bands.items():
            files.append((f"{at}/{file}", kind, interleave, values))
        b, pair = p.perp_baseline_m, at.removeprefix("pairs/")
        write_bytes(spark, f"{folder}/baselines/{pair}/{pair}.txt", f"swath: IW1\nBperp (average): {b - 1}\nswath: IW2\nBperp (average): {b + 1}\n".encode())
    total = F.abs(c[0] + c[1] + c[2])
    there = total % 10 != 3
    files.append(("geometry/los.rdr", "f4", "pixel", [F.when(there, 30 + total % 9).otherwise(0), F.when(there, 100 - total % 5 * 0.5).otherwise(0)]))
    for name, kind, interleave, values in files:
        _vrt(spark, f"{folder}/{name}", shape, kind, 1 if kind == "c8" else len(values), interleave)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(i).alias("interleave"), F.array(*[v.cast("double") for v in values]).alias("bands")) for name, kind, i, values in files]))
    _write_raw(px.select("row", "col", rows.alias("x")).select("row", "col", "x.*"), shape, folder)
    return folder


_GRID = f"""{X.series_sql()}, g AS (SELECT r::INT AS "row", c::INT AS col FROM (SELECT max("row") AS mr, max(col) AS mc FROM s) m, LATERAL (SELECT unnest(range(0, mr + 1)) AS r), LATERAL (SELECT unnest(range(0, mc + 1)) AS c)),
x AS (SELECT g."row", g.col, {", ".join(f"coalesce(sum({v}) FILTER (e = {k}), 0)::BIGINT AS {a}{k}" for v, a in (("cents", "c"), ("n", "n")) for k in range(3))}, count(s.e) > 0 AS known FROM g LEFT JOIN s ON s."row" = g."row" AND s.col = g.col GROUP BY ALL),
k AS (SELECT * FROM (VALUES (0, '2024-01-01', '2024-01-13', 12.5::DOUBLE), (1, '2024-01-01', '2024-01-25', -7.5::DOUBLE), (2, '2024-01-13', '2024-01-25', -20.0::DOUBLE)) AS v(n, a, b, bperp)),
y AS (SELECT "row", col, k.n, a, b, bperp, CASE k.n WHEN 0 THEN c1 - c0 WHEN 1 THEN c2 - c0 ELSE c2 - c1 END AS cents, CASE k.n WHEN 0 THEN n0 + n1 WHEN 1 THEN n0 + n2 ELSE n1 + n2 END AS events, CASE k.n WHEN 0 THEN n1 ELSE n2 END % 7 AS amp FROM x, k)"""


@query(f"""WITH {_GRID} SELECT "row", col, n::INT AS pair_idx, a AS ref_day, b AS sec_day, bperp AS perp_baseline_m, (cents % 1009 / 8.0)::DOUBLE AS phase, (events % 8 / 8.0)::DOUBLE AS coh FROM y WHERE amp > 0""")
def isce_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped phase masked by amplitude, coherence, dates and baselines of an ISCE folder."""
    folder = _isce_folder(spark, sf_dir)
    stack = isce.read_unwrapped(spark, f"{folder}/pairs", isce.IsceConfig(baselines=f"{folder}/baselines"))
    pairs = [(k, str(stack.epochs[p.ref]), str(stack.epochs[p.sec]), p.perp_baseline_m) for k, p in enumerate(stack.pairs)]
    known = spark.createDataFrame(pairs, "pair_idx int, ref_day string, sec_day string, perp_baseline_m double")
    long = stack.px.select("row", "col", F.posexplode(F.arrays_zip("phase", "coh")).alias("pair_idx", "x")).select("row", "col", "pair_idx", "x.phase", "x.coh").where("phase is not null")
    return long.join(F.broadcast(known), "pair_idx").select("row", "col", "pair_idx", "ref_day", "sec_day", "perp_baseline_m", "phase", "coh")  # a row a pair


@query(f"""WITH {_GRID} SELECT "row", col, n::INT AS pair_idx, CASE WHEN amp > 0 THEN (cents % 9 - 4.5)::DOUBLE END AS re, CASE WHEN amp > 0 THEN (cents % 6 + 0.25)::DOUBLE END AS im, (events % 4)::SMALLINT AS component FROM y""")
def isce_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped interferograms, exact zeros as NoData, beside their connected components."""
    folder = f"{_isce_folder(spark, sf_dir)}/pairs"
    rows, *_ = isce.read_wrapped(spark, folder)
    return rows.join(isce.read_components(spark, folder), ["row", "col", "pair_idx"]).select("row", "col", "pair_idx", "re", "im", "component")


@query(f"""WITH {_GRID}, t AS (SELECT "row", col, abs(c0 + c1 + c2) AS total, known FROM x)
SELECT "row", col, CASE WHEN known AND total % 10 <> 3 THEN (30 + total % 9)::DOUBLE END AS incidence_deg, CASE WHEN known AND total % 10 <> 3 THEN (100 - total % 5 * 0.5)::DOUBLE END AS azimuth_deg FROM t""")
def isce_line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidence and azimuth, interleaved pixel by pixel; both zero is NoData."""
    return isce.read_los(spark, f"{_isce_folder(spark, sf_dir)}/geometry/los.rdr")


@query(f"""WITH {_GRID} SELECT "row", col, o.m::INT AS pair_idx, CASE WHEN known AND amp > 0 THEN (cents % 1009 / 8.0)::DOUBLE END AS phase, CASE WHEN known THEN (events % 8 / 8.0)::DOUBLE ELSE 0 END AS coh,
CASE WHEN known THEN (abs(c0 + c1 + c2) % 3000 / 2.0)::DOUBLE ELSE 0 END AS height_m FROM y JOIN x USING ("row", col) JOIN (VALUES (0, 0), (1, 2), (2, 1)) AS o(n, m) ON o.n = y.n""")
def raw_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meta.json with phase.f32, coherence.f32 and dem.f32, written by tasks from what the table holds: an exported stack, with the line of sight that goes with it."""
    px, shape = _epochs(spark, sf_dir)
    folder = new_path(spark, "cube")
    c, n = ([F.col(f"{x}{e}") for e in range(3)] for x in "cn")
    phase = [F.when(n[p.sec] % 7 > 0, (c[p.sec] - c[p.ref]) % 1009 / 8).otherwise(float("nan")) for p in _PAIRS]
    cubes = {"phase.f32": phase, "coherence.f32": [(n[p.ref] + n[p.sec]) % 8 / 8 for p in _PAIRS], "dem.f32": [F.abs(c[0] + c[1] + c[2]) % 3000 / 2]}
    put = writer(spark, folder)

    def write(t: pa.Table) -> pa.Table:
        values = np.array(t["bands"].to_pylist(), float)
        cube = np.zeros((values.shape[1], *shape), "<f4")
        if values.shape[1] > 1 and t["name"][0].as_py() == "phase.f32":
            cube[:] = np.nan
        cube[:, t["row"].to_numpy(), t["col"].to_numpy()] = values.T
        put(t["name"][0].as_py(), cube.tobytes())
        return pa.table({"name": t["name"].slice(0, 1)})

    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[v.cast("double") for v in values]).alias("bands")) for name, values in cubes.items()]))
    px.select("row", "col", rows.alias("x")).select("row", "col", "x.*").groupBy("name").applyInArrow(write, "name string").collect()
    about = {"rows": shape[0], "cols": shape[1], "n_pairs": 3, "epochs": [str(d) for d in _DAYS], "pairs": [[p.ref, p.sec, p.perp_baseline_m] for p in _PAIRS], "wavelength_m": 0.0555, "incidence_deg": 39.0, "los_vector": [-0.6, -0.1, 0.8]}
    write_bytes(spark, f"{folder}/meta.json", json.dumps(about).encode())
    stack = manifest.read_raw_cube(spark, folder)
    if stack.meta.los_vector != (-0.6, -0.1, 0.8) or stack.pairs != _PAIRS:
        raise MetadataError("the cube's metadata were not read back")
    return stack.px.select("row", "col", "height_m", F.posexplode(F.arrays_zip("phase", "coh")).alias("pair_idx", "x")).select("row", "col", "pair_idx", "x.phase", "x.coh", "height_m")


# --- a whole run ---

_RUN = f"""{X.series_sql()}, t AS (SELECT "row", col, abs(sum(cents))::BIGINT AS c FROM s GROUP BY 1, 2), v AS (SELECT "row", col, (c % 100 - 50) * 0.0001::DOUBLE AS v, (20 + ("row" * 7 + col * 13 + c) % 80) / 100.0 AS coh FROM t),
best AS (SELECT v AS v0 FROM v ORDER BY coh DESC, "row", col LIMIT 1)"""


@query(f"""WITH {_RUN} SELECT 'velocity' AS what, -1 AS epoch_idx, "row", col, {rs('v - v0', 'value')} FROM v, best UNION ALL SELECT 'temporal coherence', -1, "row", col, 1.0 FROM v
UNION ALL SELECT 'series', e::INT, "row", col, {rs(f'(v - v0) * e * {X.DAYS} / 365.25', 'value')} FROM v, best, (SELECT unnest(range(0, {X.EPOCHS})) AS e) UNION ALL SELECT 'closures', -1, "row", col, 0.0 FROM v""")
def sbas_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stack of GeoTIFF files to products as files, read back: unwrapping, closure, reference at the most coherent pixel, inversion, velocity; the motion is the table's."""
    c = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.abs(F.sum("cents")).alias("c"))
    shape = X.shape(c)
    px = c.select("row", "col", ((F.col("c") % 100 - 50) * 0.0001).alias("v"), ((20 + (F.col("row") * 7 + F.col("col") * 13 + F.col("c")) % 80) / 100.0).alias("coh"))
    t, rows = years(X.EPOCH_DATES), []
    for k, p in enumerate(X.ALL_PAIRS):
        f = F.col("v") * float(t[p.sec] - t[p.ref]) * (-4 * math.pi / WAVELENGTH_M)
        rows += [F.struct(F.lit(f"{n}").alias("name"), x.cast("double").alias("x")) for n, x in ((f"ifg_{k}_re", F.cos(f)), (f"ifg_{k}_im", F.sin(f)), (f"coh_{k}", F.col("coh")))]
    folder = new_path(spark, "run")
    geotiff.write_layers(px.select("row", "col", F.explode(F.array(*rows)).alias("l")).select("row", "col", "l.*"), "name", "x", shape, _META, folder)
    manifest.write_stack_json(spark, folder, Stack(px, X.EPOCH_DATES, X.ALL_PAIRS, shape, _META), coherence=[f"coh_{k}.tif" for k in range(len(X.ALL_PAIRS))])
    pipeline.write(pipeline.run_sbas(spark, folder, pipeline.SbasConfig(aps_window=1)), f"{folder}/out")
    out = None
    for what, name in (("velocity", "velocity"), ("temporal coherence", "temporal_coherence"), ("closures", "closure_qc")):
        back = manifest.read_map(spark, f"{folder}/out/{name}.tif", Meta(), "value")[0].select(F.lit(what).alias("what"), F.lit(-1).alias("epoch_idx"), "row", "col", r(F.col("value")).alias("value"))
        out = back if out is None else out.unionAll(back)
    series = to_long(manifest.read_series(spark, f"{folder}/out/series", Meta()).px, "epoch_idx", "value", "disp")
    return out.unionAll(series.select(F.lit("series"), "epoch_idx", "row", "col", r(F.col("value")))).where("value is not null")


@query(f"""WITH {_RUN} SELECT "row", col, {rs('coalesce(v * 100, 0)', 'filled')}, CASE WHEN coh < 0.4 THEN 0.0 ELSE {rs('coh', 'x').removesuffix(' AS x')} END AS filled_coherence, CASE WHEN coh >= 0.4 THEN {rs('v * 200', 'x').removesuffix(' AS x')} END AS phase FROM (SELECT "row", col, CASE WHEN coh >= 0.4 THEN v END AS v, coh FROM v)""")
def zero_filled_and_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an outside unwrapper is given: no data as phase and coherence 0; and its answer (here twice the phase) with the gaps put back."""
    c = X.long_series(spark, sf_dir).groupBy("row", "col").agg(F.abs(F.sum("cents")).alias("c"))
    coh = (20 + (F.col("row") * 7 + F.col("col") * 13 + F.col("c")) % 80) / 100.0
    layers = c.select("row", "col", coh.alias("coh"), F.when(coh >= 0.4, (F.col("c") % 100 - 50) * 0.01).otherwise(float("nan")).alias("wrapped"))
    given = unwrapping.zero_filled(layers)
    back = unwrapping.restored(given.withColumn("phase", F.col("wrapped") * 2))
    return back.select("row", "col", r(F.col("wrapped")).alias("filled"), r(F.col("coh")).alias("filled_coherence"), r(F.col("phase")).alias("phase"))


# --- chunked products ---


@query(f"""WITH {_GRID} SELECT "row", col - 1 AS col, n::INT AS pair_idx, a AS ref_day, b AS sec_day, bperp AS perp_baseline_m, CASE WHEN known AND events % 4 > 0 THEN (cents % 1009 / 8.0)::DOUBLE END AS phase, CASE WHEN known THEN (events % 8 / 8.0)::DOUBLE ELSE 0 END AS coh
FROM y JOIN x USING ("row", col) WHERE col >= 1""")
def chunked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped products in chunked files that tasks write from the table, their grids shifted against each other, read over a window; connected component 0 is no data."""
    px, shape = _epochs(spark, sf_dir)
    folder = new_path(spark, "products")
    put = writer(spark, folder)
    c, n = ([F.col(f"{x}{e}") for e in range(3)] for x in "cn")
    rows = []
    for k, p in enumerate(_PAIRS):
        name = f"S1-GUNW-A-R-018-tops-{_DAYS[p.sec]:%Y%m%d}_{_DAYS[p.ref]:%Y%m%d}-x.nc"
        values = [(c[p.sec] - c[p.ref]) % 1009 / 8, (n[p.ref] + n[p.sec]) % 8 / 8, (n[p.ref] + n[p.sec]) % 4]
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(k).alias("shift"), F.lit(float(p.perp_baseline_m)).alias("baseline"), F.array(*[v.cast("double") for v in values]).alias("bands")))

    def write(t: pa.Table) -> pa.Table:
        values, shift = np.array(t["bands"].to_pylist(), float), t["shift"][0].as_py()
        grid = np.zeros((3, shape[0], shape[1] + shift))  # a file that begins further west
        grid[:, t["row"].to_numpy(), t["col"].to_numpy() + shift] = values.T
        lon, lat = -70 + (np.arange(shape[1] + shift) - shift) / 64, -30 - np.arange(shape[0]) / 64
        put(t["name"][0].as_py(), hdf5.encode({
            hdf5.PHASE: (grid[0].astype("<f4"), (16, 8)), hdf5.COHERENCE: (grid[1].astype("<f4"), (16, 8)), hdf5.COMPONENTS: (grid[2].astype("<i2"), (32, 4)),
            hdf5.LONGITUDE: (lon, None), hdf5.LATITUDE: (lat, (64,)), hdf5.BASELINE: (np.full((2, 2), t["baseline"][0].as_py(), "<f4"), None),
        }))
        return pa.table({"name": t["name"].slice(0, 1)})

    made = px.select("row", "col", F.explode(F.array(*rows)).alias("x")).select("row", "col", "x.*").groupBy("name").applyInArrow(write, "name string").collect()
    stack, left = hdf5.read_products(spark, [f"{folder}/{r.name}" for r in made], (-70 + 1 / 64, -1e9, 1e9, -30.0))
    if left:
        raise MetadataError("a product was left out")
    pairs = [(k, str(stack.epochs[p.ref]), str(stack.epochs[p.sec]), p.perp_baseline_m) for k, p in enumerate(stack.pairs)]
    known = spark.createDataFrame(pairs, "pair_idx int, ref_day string, sec_day string, perp_baseline_m double")
    long = stack.px.select("row", "col", F.posexplode(F.arrays_zip("phase", "coh")).alias("pair_idx", "x")).select("row", "col", "pair_idx", "x.phase", "x.coh")
    return long.join(F.broadcast(known), "pair_idx").select("row", "col", "pair_idx", "ref_day", "sec_day", "perp_baseline_m", "phase", "coh")  # a row a pair


# three pairs of three epochs: the least-squares increments have a closed form, also where one pair is missing
@query(f"""WITH {_GRID}, v AS (SELECT "row", col, n, (cents % 1009 / 8.0)::DOUBLE AS phase, (events % 8 / 8.0)::DOUBLE AS coh FROM y WHERE amp > 0),
best AS (SELECT "row" AS r0, col AS c0 FROM v GROUP BY 1, 2 ORDER BY count(*) DESC, avg(coh)::FLOAT DESC, 1, 2 LIMIT 1),
p AS (SELECT "row", col, max(phase) FILTER (n = 0) AS a, max(phase) FILTER (n = 1) AS c, max(phase) FILTER (n = 2) AS b FROM v GROUP BY 1, 2),
q AS (SELECT p."row", p.col, p.a - o.a AS a, p.b - o.b AS b, p.c - o.c AS c FROM p, best JOIN p o ON o."row" = r0 AND o.col = c0),
w AS (SELECT "row", col, CASE WHEN a IS NULL THEN c - b WHEN b IS NULL OR c IS NULL THEN a ELSE (2 * a + c - b) / 3 END AS x1, CASE WHEN b IS NULL THEN c - a WHEN a IS NULL OR c IS NULL THEN b ELSE (2 * b + c - a) / 3 END AS x2
  FROM q WHERE (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT <= 1)
SELECT "row", col, {rs(f'-(x1 + x2) / {X.K_SQL} / (24 / 365.25)', 'velocity')}, {rs(f'-x1 / {X.K_SQL}', 'second_m')}, {rs(f'-(x1 + x2) / {X.K_SQL}', 'third_m')} FROM w""")
def isce_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From an ISCE folder to series and velocity: masked by amplitude, referenced to the most coherent pixel, inverted by least squares."""
    got = pipeline.run_sbas_isce(spark, f"{_isce_folder(spark, sf_dir)}/pairs", pipeline.SbasConfig(correct_closure=False))
    px = got.series.px.join(got.velocity, ["row", "col"]).where("velocity is not null")
    return px.select("row", "col", r(F.col("velocity")).alias("velocity"), r(F.col("disp")[1]).alias("second_m"), r(F.col("disp")[2]).alias("third_m"))
