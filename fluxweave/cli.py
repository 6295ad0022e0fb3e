"""Command line: find sources in a FITS file with a local or configured Spark session."""

from __future__ import annotations

import argparse

from fluxweave import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fluxweave", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("image", nargs="?", help="FITS image")
    parser.add_argument("output", nargs="?", help="folder to publish")
    parser.add_argument("--profile", default="continuum", choices=("continuum", "compact"))
    args = parser.parse_args(argv)
    if args.image and args.output:
        from pyspark.sql import SparkSession

        from fluxweave.plans.finder import FinderConfig, find_sources_in_file

        find_sources_in_file(SparkSession.builder.getOrCreate(), args.image, args.output, FinderConfig(profile=args.profile))
    else:
        parser.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
