"""python -m ocellus --slides ... --detections ... --tumors ... --output ..."""

from __future__ import annotations

import argparse
from dataclasses import fields

from ocellus.config import EngineConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ocellus", description="Cell tables and summaries from detections.")
    for name in ("slides", "detections", "tumors", "output"):
        p.add_argument(f"--{name}", required=True, help="parquet table" if name != "output" else "folder for cells and summary")
    for f in fields(EngineConfig):
        if isinstance(f.default, bool):
            p.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=f.default)
        elif isinstance(f.default, (int, float)):
            p.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
    return p


def config_of(args: argparse.Namespace) -> EngineConfig:
    return EngineConfig(**{f.name: getattr(args, f.name) for f in fields(EngineConfig) if hasattr(args, f.name)}).validated()


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ocellus.operators.analysis import analyze
    from ocellus.sources.readers import write_cells, write_summary

    args = parser().parse_args(argv)
    config = config_of(args)
    spark = SparkSession.builder.appName("ocellus").getOrCreate()
    slides, detections, tumors = (spark.read.parquet(getattr(args, n)) for n in ("slides", "detections", "tumors"))
    extent = slides.agg(F.max(F.greatest("width", "height"))).first()[0] or 1
    out = analyze(slides, detections, tumors, config, int(extent))
    write_cells(out["cells"], f"{args.output}/cells")
    write_summary(out["summary"], f"{args.output}/summary")


if __name__ == "__main__":
    main()
