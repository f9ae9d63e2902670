"""``python -m voidloom run|homology|batch|flow``: analyses of structure files from settings files."""

from __future__ import annotations

import argparse
from dataclasses import replace

from .plans import pipelines
from .session import session
from .sources import config, sinks


def homology(path: str, fmt: str, ext: str | None, made: config.Structure, compute: config.Computation, out: str) -> None:
    """Diagrams of a file, or with ``ext`` of all files below a folder in one plan, and the files' names beside them."""
    spark = session()
    points = pipelines.sample_points(spark, path, fmt, made, ext)
    sinks.write_diagrams(pipelines.persistent_homology(points, compute)["diagrams"], f"{out}/diagrams")
    if ext:
        pipelines.sample_names(spark, path, fmt, made, ext).write.mode("overwrite").csv(f"{out}/samples", header=True)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="voidloom")
    kinds = parser.add_subparsers(dest="kind", required=True)
    p = kinds.add_parser("run", help="what a section of an INI file tells: SINGLE, MULTI or BATCH")
    p.add_argument("settings")
    p.add_argument("section")
    p.add_argument("out")
    for name, what in (("homology", "a structure file"), ("batch", "a folder of structure files")):
        p = kinds.add_parser(name, help=f"diagrams of {what}")
        p.add_argument("path")
        p.add_argument("settings")
        p.add_argument("section")
        p.add_argument("out")
        p.add_argument("--format", default="extxyz")
        p.add_argument("--ext", default=".xyz")
    p = kinds.add_parser("flow", help="circular flow through the mean backbone of a trajectory")
    p.add_argument("config")
    p.add_argument("--trajectory-path")
    p.add_argument("--grid-spacing", type=float)
    p.add_argument("--reeb-stride", type=int)
    p.add_argument("--output-csv")
    args = parser.parse_args(argv)
    if args.kind == "flow":
        settings = config.flow(args.config, trajectory_path=args.trajectory_path, grid_spacing=args.grid_spacing, reeb_stride=args.reeb_stride, output_csv=args.output_csv)
        result = pipelines.flow_of_file(session(), settings)
        sinks.write_flow(result, settings.output_csv) if settings.output_csv else result.show()
    elif args.kind == "run":
        job = config.job(args.settings, args.section)
        made = replace(config.structure(job.configuration_file, job.configuration_name), start=job.start, stop=job.stop, step=job.step)
        homology(job.path, job.file_format, job.ext, made, config.computation(args.settings, args.section), args.out)
    else:
        made, compute = config.structure(args.settings, args.section), config.computation(args.settings, args.section)
        homology(args.path, args.format, args.ext if args.kind == "batch" else None, made, compute, args.out)


if __name__ == "__main__":
    main()
