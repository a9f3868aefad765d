"""Run the whole analysis: ``python -m claimspark INPUT_DIR OUTPUT_DIR [--parquet] [--no-models]``.

INPUT_DIR holds patients, providers, claims and investigations as
``<name>.csv`` (header, the published column layout) or ``<name>.parquet``.
Every result table is written under OUTPUT_DIR.  The session comes from the
environment (``spark-submit`` settings); ``--master`` sets one for local runs.
"""

from __future__ import annotations

import argparse

from claimspark.plans.report import read_inputs, run_report
from claimspark.session import get_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="claimspark")
    ap.add_argument("input_dir")
    ap.add_argument("output_dir")
    ap.add_argument("--parquet", action="store_true", help="inputs are <name>.parquet")
    ap.add_argument("--no-models", action="store_true", help="skip the classifiers")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    spark = get_session(args.master)
    tables = read_inputs(spark, args.input_dir, "parquet" if args.parquet else "csv")
    for name in run_report(spark, tables, args.output_dir, with_models=not args.no_models):
        print(f"wrote {args.output_dir.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
