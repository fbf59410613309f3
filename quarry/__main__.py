"""python -m quarry list | run QUERY FOLDER [ROWS] | explain QUERY FOLDER."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quarry.plans import catalog


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print(*sorted(catalog.QUERIES), sep="\n")
        return 0
    if len(args) < 3 or args[0] not in ("run", "explain") or args[1] not in catalog.QUERIES:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = catalog.QUERIES[args[1]](spark, args[2])
    if args[0] == "run":
        df.show(int(args[3]) if len(args) > 3 else 20, truncate=60)
    else:
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
