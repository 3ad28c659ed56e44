"""Command line of the jobs: ``python -m shelfmark clean --catalog .. --out ..``."""

from __future__ import annotations

import argparse

from shelfmark.plans.analyse import run_analysis
from shelfmark.plans.clean import run_clean
from shelfmark.plans.harvest import run_harvest, run_increment
from shelfmark.schema import CLUSTERS, ROWS_PER_FILE
from shelfmark.session import build_session
from shelfmark.sources.readers import stopword_list


def main() -> None:
    parser = argparse.ArgumentParser(prog="shelfmark")
    parser.add_argument("--master", help="Spark master; taken from the environment when left out")
    jobs = parser.add_subparsers(dest="job", required=True)

    harvest = jobs.add_parser("harvest", help="merge NDJSON drops into a catalogue")
    harvest.add_argument("--catalog", nargs="+", required=True)
    harvest.add_argument("--drops", nargs="+", required=True)

    increment = jobs.add_parser("increment", help="take in new drops, merge all that is held, list the ids still to fetch")
    increment.add_argument("--catalog", nargs="+", required=True)
    increment.add_argument("--drops", required=True)
    increment.add_argument("--state", required=True, help="folder kept from run to run")
    increment.add_argument("--latest", type=int, help="highest id there is upstream")

    clean = jobs.add_parser("clean", help="clean a catalogue")
    clean.add_argument("--catalog", nargs="+", required=True)
    clean.add_argument("--base-url", required=True, help="put in front of poster paths")
    clean.add_argument("--rows-per-file", type=int, default=ROWS_PER_FILE)

    analyse = jobs.add_parser("analyse", help="all reports over a cleaned catalogue")
    analyse.add_argument("--cleaned", nargs="+", required=True)
    analyse.add_argument("--vectors", required=True)
    analyse.add_argument("--clusters", type=int, default=CLUSTERS)
    analyse.add_argument("--wide-prefix", help="vectors are columns with this prefix and a number")

    analyse.add_argument("--zero-width", type=int, help="rows without a vector get a zero vector of this width")
    analyse.add_argument("--multi-line", action="store_true", help="there are line breaks inside CSV fields")

    for job in (clean, analyse):
        job.add_argument("--stopwords", help="folder with one list of words per language")
        job.add_argument("--language", default="english", help="the list to take from there")
    for job in (harvest, increment, clean, analyse):
        job.add_argument("--out", required=True)
    for job in (harvest, increment, clean):
        job.add_argument(
            "--single-line", action="store_true", help="no line breaks inside CSV fields: read in parallel"
        )
    args = parser.parse_args()

    spark = build_session(f"shelfmark-{args.job}", args.master)
    listed = getattr(args, "stopwords", None)
    words = stopword_list(spark, listed, args.language) if listed else None
    if args.job == "harvest":
        print(run_harvest(spark, args.catalog, args.drops, args.out, not args.single_line))
    elif args.job == "increment":
        print(run_increment(spark, args.catalog, args.drops, args.state, args.out, args.latest, not args.single_line))
    elif args.job == "clean":
        extra = {"stopwords": words} if words else {}
        print(run_clean(spark, args.catalog, args.out, args.base_url, args.rows_per_file, not args.single_line, **extra))
    else:
        print(run_analysis(
            spark, args.cleaned, args.vectors, args.out, k=args.clusters, wide_prefix=args.wide_prefix,
            multi_line=args.multi_line, stopwords=words, zero_width=args.zero_width,
        ))
    spark.stop()


if __name__ == "__main__":
    main()
