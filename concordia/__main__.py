"""Command line: python -m concordia compare | fill | pipeline."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from concordia.runs import compare, fill


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="concordia", description="Compares packages of models with a published document and fills descriptions.")
    runs = top.add_subparsers(dest="run", required=True)
    for name in ("compare", "pipeline"):
        p = runs.add_parser(name)
        p.add_argument("--packages", required=True, help="a bundle, a package or a folder of packages")
        p.add_argument("--document", required=True, help="a .docx file")
        p.add_argument("--out", required=True)
        for option in ("names", "extractor", "flex-file", "pages", "links", "cache"):
            p.add_argument(f"--{option}", default="")
        p.add_argument("--scope-mode", choices=jobs_modes(), default="anchor-window")
        p.add_argument("--include-pass", action="store_true")
        p.add_argument("--scope-debug", action="store_true")
    for name in ("fill", "pipeline"):
        p = runs.choices[name] if name in runs.choices else runs.add_parser(name)
        if name == "fill":
            p.add_argument("--rows", required=True, help="the table of missing fields of a comparison")
            p.add_argument("--out", required=True)
            p.add_argument("--pages", default="")
            p.add_argument("--flex-file", default="")
        p.add_argument("--mapping", required=name == "fill", default="", help="a file of TABLE=URL lines")
        p.add_argument("--tables", default="")
        p.add_argument("--alias", action="append", default=[])
        p.add_argument("--rules", default="")
        p.add_argument("--books", default="")
        p.add_argument("--skip-pages", action="store_true")
    return top


def jobs_modes() -> tuple[str, ...]:
    from concordia.operators import jobs

    return tuple(jobs.MODES)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs what the arguments say; the verdict of a comparison, or the counts of filling."""
    a, said = parser().parse_args(args), ""
    spark = spark or SparkSession.builder.appName("concordia").getOrCreate()
    if a.run != "fill":
        said, stages = compare.run(spark, compare.Options(a.packages, a.document, a.out, a.names, a.extractor, a.scope_mode, a.include_pass, a.scope_debug, a.flex_file, a.pages, a.links, a.cache))
        rows = f"{a.out}/_stages/missing-{stages.key}"
    else:
        rows = a.rows
    if a.run == "fill" or a.run == "pipeline" and a.mapping:
        counts = fill.run(spark, fill.Options(rows, a.mapping, a.out, a.pages, a.tables, a.alias, a.rules, a.flex_file, a.books, a.skip_pages))
        said = " ".join([said, *(f"{k}={v}" for k, v in counts.items())]).strip()
    return said


if __name__ == "__main__":
    try:
        print(main())
    except ValueError as error:
        sys.exit(str(error))
