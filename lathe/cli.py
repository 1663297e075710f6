"""Command line: ``python -m lathe.cli in[file] column where[..] ...`` writes CSV to the standard output."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from lathe.plans.planner import Planner
from lathe.plans.spec import SpecError, load
from lathe.sink import write_stream
from lathe.sources.files import open_source

USAGE = """usage: lathe COLUMN_OR_DIRECTIVE...
Example: python -m lathe.cli in[visits.tsv] page visits:count[page] where[seconds>5] sort[-visits]
A column is name:expression; directives are in[file] join[file] where[..] sort[..] first[n] top[n] distinct[true] sync[path]
root[n] case[true] csvonly[true] inheader[false] joinheader[false] outheader[false]; @file reads arguments from a file."""


def main(args: list[str], out=None) -> int:
    out = out or sys.stdout
    spooled = None
    try:
        specs = load(args)
        ops = {getattr(s.expr, "op", None) for s in specs}
        if not args or ops & {"help", "usage"}:
            print(USAGE, file=out)
            return 0
        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        planner = Planner(spark, specs, keep_order=True, records=False)
        q = planner.query
        if "in" not in q.directives:
            if q.pivot and len(q.pivot.expr.args) > 2 and q.pivot.expr.args[2].value:
                raise SpecError("Given query requires two passes, so stdin cannot be used as an input.")
            with tempfile.NamedTemporaryFile("wb", suffix=".in", delete=False) as spool:
                spooled = spool.name
                shutil.copyfileobj(sys.stdin.buffer, spool)
            planner.source = open_source(spark, spool.name, q.flag("inheader", True), q.flag("csvonly"), records=False)
        header = q.flag("outheader", True) and q.flag("header", True)
        df = planner.plan()
        planner.check_paths()
        write_stream(df, out, header)
        return 0
    except SpecError as error:
        print(error, file=sys.stderr)
        return 255
    finally:
        if spooled:
            os.unlink(spooled)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
