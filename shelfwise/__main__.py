"""Run one analysis from the command line.

    python -m shelfwise --star /warehouse/star q14_revenue_by_region_category --show 20
    python -m shelfwise --tpch /root/testdata/sf0.01 q20_abc_classification --out /tmp/abc
    python -m shelfwise --list
    python -m shelfwise --star /warehouse/star --validate

``--star`` reads a star written by ``write_star``; ``--tpch`` builds one from
TPC-H-like tables. ``--as-of YYYY-MM-DD`` sets the reference day of the
analyses that take one. ``--out`` writes the result as Parquet (overwrite).
"""

from __future__ import annotations

import argparse
import inspect
import sys

from shelfwise.plans import ANALYSES


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m shelfwise", description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    source = parser.add_mutually_exclusive_group()
    source.add_argument("--star", help="directory written by write_star")
    source.add_argument("--tpch", help="directory of TPC-H-like parquet tables")
    parser.add_argument("analysis", nargs="?", help="analysis key, e.g. q07_reorder_point")
    parser.add_argument("--as-of", dest="as_of", help="reference day (YYYY-MM-DD)")
    parser.add_argument("--out", help="write the result here as Parquet")
    parser.add_argument("--show", type=int, default=20, help="rows to print when --out is not given")
    parser.add_argument("--list", action="store_true", help="list the analysis keys")
    parser.add_argument("--validate", action="store_true", help="print the star's integrity report")
    args = parser.parse_args(argv)

    if args.validate:
        if not (args.star or args.tpch):
            parser.error("give --star or --tpch")
        from shelfwise.sources import validate

        spark, star, started = _open(args)
        validate(star).show(truncate=False)
        if started:
            spark.stop()
        return 0
    if args.list or not args.analysis:
        print("\n".join(ANALYSES))
        return 0
    if args.analysis not in ANALYSES:
        parser.error(f"unknown analysis {args.analysis!r}; see --list")
    if not (args.star or args.tpch):
        parser.error("give --star or --tpch")

    spark, star, started = _open(args)
    fn = ANALYSES[args.analysis]
    kwargs = {}
    if args.as_of:
        if "as_of" not in inspect.signature(fn).parameters:
            parser.error(f"{args.analysis} takes no reference day")
        kwargs["as_of"] = args.as_of
    result = fn(star, **kwargs)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
        print(f"wrote {args.out}")
    else:
        result.show(args.show, truncate=False)
    if started:
        spark.stop()
    return 0


def _open(args: argparse.Namespace):
    """Session and star; the session is stopped at the end only if this call started it."""
    from pyspark.sql import SparkSession

    from shelfwise.sources import load_star, read_star

    started = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("shelfwise").getOrCreate()  # master and settings as submitted
    star = read_star(spark, args.star) if args.star else load_star(spark, args.tpch)
    return spark, star, started


if __name__ == "__main__":
    sys.exit(main())
