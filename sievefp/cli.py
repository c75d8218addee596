"""python -m sievefp.cli INPUT OUTPUT: a fingerprint dataset of a molecule file, in one Spark job."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sievefp.sources import featurize, store


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="sievefp", description=__doc__)
    parser.add_argument("input", help=".smi or .sdf file, or a folder of them that Spark reads; may be compressed")
    parser.add_argument("output", help="folder of the new dataset")
    parser.add_argument("--fp_type", default="Morgan", choices=list(featurize.DEFAULTS))
    parser.add_argument("--fp_params", type=json.loads, default={"radius": 2, "fpSize": 256}, help="JSON")
    parser.add_argument("--no_full_sanitization", action="store_true")
    parser.add_argument("--processes", type=int, default=8, help="local cores, where no master is set")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = arguments(given)
    builder = SparkSession.builder.appName("sievefp")
    spark = SparkSession.getActiveSession() or builder.config("spark.master", f"local[{args.processes}]").getOrCreate()
    store.create_from_molecules(spark, args.input, args.output, args.fp_type, args.fp_params, full_sanitization=not args.no_full_sanitization)


if __name__ == "__main__":
    main()
