"""Command line: python -m fringeflow.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fringeflow.errors import FringeError
from fringeflow.functions.phase import WAVELENGTH_M
from fringeflow.operators import decompose, features, filters, network, ps
from fringeflow.operators.cube import Meta
from fringeflow.operators.troposphere import correct_series
from fringeflow.plans import pipeline
from fringeflow.sources import geotiff, isce, manifest


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fringeflow")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str):
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        return c

    def reference(c):
        c.add_argument("--ref-row", type=int)
        c.add_argument("--ref-col", type=int)
        c.add_argument("--ref-region", type=int, nargs=4, metavar=("ROW0", "COL0", "ROW1", "COL1"))
        c.add_argument("--deramp", choices=["linear", "quadratic"])
        c.add_argument("--no-closure-correction", action="store_true")

    command("info", "dir")
    command("ps", "dir").add_argument("--threshold", type=float, default=0.4)
    command("network", "dir")
    run = command("run", "input", "output")
    run.add_argument("--ps-threshold", type=float)
    run.add_argument("--min-quality", type=float)
    reference(run)
    d = command("decompose", "asc_los", "desc_los", "output")
    for x in ("--asc-incidence-deg", "--asc-heading-deg", "--desc-incidence-deg", "--desc-heading-deg"):
        d.add_argument(x, type=float, required=True)
    f = command("features", "series_dir", "output")
    f.add_argument("--no-seasonal", action="store_true")
    f.add_argument("--no-acceleration", action="store_true")
    f.add_argument("--min-valid-epochs", type=int, default=5)
    f.add_argument("--csv", action="store_true")
    command("deramp", "series_dir", "output").add_argument("kind", choices=["linear", "quadratic"])
    a = command("aps", "series_dir", "output")
    a.add_argument("--spatial-sigma-px", type=float, default=8.0)
    a.add_argument("--temporal-window-epochs", type=int, default=5)
    t = command("tropo-era5", "series_dir", "delay_dir", "output")
    t.add_argument("--reference-epoch", type=int, default=0)
    for name in ("features", "deramp", "aps", "tropo-era5"):
        sub.choices[name].add_argument("--wavelength-m", type=float, default=WAVELENGTH_M)
    i = command("isce", "input", "output")
    i.add_argument("--baselines")
    i.add_argument("--wls", action="store_true")
    i.add_argument("--robust", action="store_true")
    i.add_argument("--dem-error-range", type=float)
    reference(i)
    return p


def _checked(parser: argparse.ArgumentParser, args: argparse.Namespace) -> None:
    if not hasattr(args, "ref_row"):
        return
    if (args.ref_row is None) != (args.ref_col is None):
        parser.error("--ref-row and --ref-col go together")
    if args.ref_region:
        if args.ref_row is not None:
            parser.error("--ref-region excludes --ref-row and --ref-col")
        r0, c0, r1, c1 = args.ref_region
        if min(args.ref_region) < 0 or r0 > r1 or c0 > c1:
            parser.error("--ref-region needs ROW0 <= ROW1 and COL0 <= COL1")


def _config(args: argparse.Namespace, **more) -> pipeline.SbasConfig:
    return pipeline.SbasConfig(
        correct_closure=not args.no_closure_correction, reference=None if args.ref_row is None else (args.ref_row, args.ref_col),
        reference_region=tuple(args.ref_region) if args.ref_region else None, deramp=args.deramp, **more,
    )


def execute(spark: SparkSession, args: argparse.Namespace) -> None:
    c = args.command
    if c in ("info", "network"):
        m = manifest.load(spark, args.dir)
        pairs = m.pairs or ()
        print(f"epochs {len(m.epochs)} ({m.epochs[0]} to {m.epochs[-1]}), pairs {len(pairs)}, wavelength {m.meta.wavelength_m} m, incidence {m.meta.incidence_deg} degrees")
        if c == "network":
            for p in pairs:
                print(f"{m.epochs[p.ref]} {m.epochs[p.sec]} {(m.epochs[p.sec] - m.epochs[p.ref]).days} d {p.perp_baseline_m:.1f} m")
            print("connected" if network.is_connected(pairs, len(m.epochs)) else "not connected")
    elif c == "ps":
        amp, m, _ = manifest.read_amplitudes(spark, args.dir)
        got = ps.select_ps(ps.amplitude_dispersion(amp, len(m.epochs)), args.threshold)
        print(f"{got.count()} candidates")
    elif c == "run":
        pipeline.write(pipeline.run_sbas(spark, args.input, _config(args, ps_threshold=args.ps_threshold, min_quality=args.min_quality)), args.output)
    elif c == "isce":
        solver = pipeline.Solver("variance" if args.wls else None, args.dem_error_range, args.robust)
        pipeline.write(pipeline.run_sbas_isce(spark, args.input, _config(args, solver=solver), isce.IsceConfig(baselines=args.baselines)), args.output)
    elif c == "decompose":
        a, meta, shape = manifest.read_map(spark, args.asc_los, Meta(), "a")
        b, _, other = manifest.read_map(spark, args.desc_los, Meta(), "b")
        if shape != other:
            raise decompose.DimensionMismatch(f"maps of different sizes: {shape} and {other}")
        got = decompose.decompose(a.join(b, ["row", "col"]), ["a", "b"], [(args.asc_incidence_deg, args.asc_heading_deg), (args.desc_incidence_deg, args.desc_heading_deg)])
        for x in ("up", "east"):
            geotiff.write_map(got, x, shape, meta, f"{args.output}/{x}.tif")
    else:
        series = manifest.read_series(spark, args.series_dir, Meta(wavelength_m=args.wavelength_m))
        if c == "features":
            config = features.FeatureConfig(not args.no_acceleration, not args.no_seasonal, args.min_valid_epochs)
            got, names = features.extract(series, config).persist(), features.names(config)
            for x in names:
                geotiff.write_map(got, x, series.shape, series.meta, f"{args.output}/{x}.tif")
            if args.csv:
                features.write_csv(features.to_table(got, names, series.meta.transform), names, f"{args.output}/features.csv")
            return
        if c == "deramp":
            series = filters.deramp(series, args.kind)
        elif c == "aps":
            series = filters.correct_aps(series, args.spatial_sigma_px, args.temporal_window_epochs)
        else:
            delays = manifest.read_series(spark, args.delay_dir, series.meta)
            if delays.shape != series.shape or delays.epochs != series.epochs:
                raise decompose.DimensionMismatch("delays are not of the series' size and dates")
            series = correct_series(series, delays.px.select("row", "col", F.col("disp").alias("delay")), args.reference_epoch)
        manifest.write_series(series, args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    _checked(parser, args)
    try:
        execute(spark or SparkSession.builder.appName("fringeflow").getOrCreate(), args)
    except FringeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0



if __name__ == "__main__":
    sys.exit(main())
