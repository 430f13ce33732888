"""``python -m leafmill QUERY --data FOLDER --out FOLDER``: run a named query and write its rows as Parquet.

``python -m leafmill --list`` names the queries. Master and configuration come from ``spark-submit``
or the environment.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from leafmill import work
from leafmill.plans import catalogue


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--list", action="store_true")
    args = parser.parse_args(argv)
    if args.list:
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    if args.query not in catalogue.QUERIES or not args.data or not args.out:
        parser.error("a known query, --data and --out are needed")
    spark = SparkSession.builder.appName(f"leafmill {args.query}").getOrCreate()
    catalogue.QUERIES[args.query](spark, args.data).write.mode("errorifexists").parquet(args.out)
    work.release()


if __name__ == "__main__":
    main()
