"""Run one query from the command line: ``python -m wardline NAME FOLDER OUT [MODULE...]``.

Queries are those of the modules named, by default of ``wardline.plans``; the
result is written to OUT as Parquet. Without arguments the names are listed.
"""

from __future__ import annotations

import importlib
import sys

from pyspark.sql import SparkSession

MODULES = ["wardline.plans.dealt", "wardline.plans.names", "wardline.plans.analytics", "wardline.plans.campaigns", "wardline.plans.pipeline", "wardline.plans.serving", "wardline.plans.flow"]


def main(args: list[str]) -> int:
    """Run the query that the arguments name; 0 when its result is written."""
    known = {name: f for m in args[3:] or MODULES for name, f in importlib.import_module(m).QUERIES.items()}
    if len(args) < 3 or args[0] not in known:
        print(__doc__, *sorted(known), sep="\n")
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    known[args[0]](spark, args[1]).write.mode("errorifexists").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
