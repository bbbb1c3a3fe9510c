"""python -m plumbline PATH: scan a file or folder; the exit code is the worst of its files' (2 limited or broken, 1 findings, 0 none)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import PlumblineError
from .limits import DEFAULT, Limits
from .plans import api
from .plans.report import FORMATTERS, batch_summary


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="plumbline", description="Scan a file or folder for content that its readers don't see.")
    p.add_argument("path")
    p.add_argument("--format", choices=sorted(FORMATTERS), default="text")
    p.add_argument("--mode", choices=["forensic", "production"], default="forensic")
    p.add_argument("--out", help="folder that Spark writes the reports to, as JSON lines; without it they are printed")
    p.add_argument("--summary", action="store_true", help="print the totals only")
    for name, value in vars(DEFAULT).items():
        p.add_argument("--max-" + name.replace("_", "-"), dest=name, type=int, default=value, metavar="N")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(argv)
    try:
        limits = Limits(**{n: getattr(a, n) for n in vars(DEFAULT)})
        s = api.scan_path(spark or SparkSession.builder.getOrCreate(), a.path, a.mode, limits)
    except PlumblineError as e:
        print(e, file=sys.stderr)
        return 2
    made = batch_summary(s.reports, s.findings, s.cross) if a.summary else FORMATTERS[a.format](s.reports, s.findings)
    if a.out:
        made.write.json(a.out)
    else:
        for row in made.toLocalIterator():  # one partition at a time
            print(row["report"] if "report" in row else "\t".join(f"{k}={v}" for k, v in row.asDict().items()))
    code = api.exit_code(s)
    s.release()
    return code


if __name__ == "__main__":
    sys.exit(main())
