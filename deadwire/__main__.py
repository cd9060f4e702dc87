"""Command line: analyse a directory tree (or a glob of trees) and write the
report.

    python -m deadwire <source root> <output dir> [--repo NAME] [--no-dts]

Without ``--repo`` the first path component under the root names the repo,
so one run covers a whole corpus of repositories. The fact tables and the
JSON report go to ``<output dir>``; the per-repo summary is printed.
"""
from __future__ import annotations

import argparse

from deadwire.plans.pipeline import Analysis
from deadwire.session import get_session
from deadwire.sources.files import scan_corpus, write_report


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="deadwire")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--repo", default=None)
    p.add_argument("--no-dts", action="store_true", help="skip .d.ts files")
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)
    spark = get_session(a.master)
    files = scan_corpus(spark, a.root, repo=a.repo, include_dts=not a.no_dts)
    analysis = Analysis.of(spark, files)
    write_report(analysis, a.out)
    analysis.summary().orderBy("repo").show(truncate=False)


if __name__ == "__main__":
    main()
