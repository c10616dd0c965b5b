"""python -m lattica QUERY DATA_FOLDER OUT_FOLDER: runs a registered query and writes its rows as Parquet; without arguments, lists the queries."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lattica.plans import registry


def main(args: list[str]) -> int:
    known = registry.queries()
    if len(args) != 3 or args[0] not in known:
        print(__doc__, *sorted(known), sep="\n")
        return int(bool(args))
    spark = SparkSession.builder.appName(f"lattica {args[0]}").getOrCreate()
    known[args[0]](spark, args[1].rstrip("/")).write.mode("errorifexists").parquet(args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
