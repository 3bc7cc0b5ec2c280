"""python -m brindle --tables DIR --query SQL | --file FILE: rows tab-separated, NULL as NULL."""

from __future__ import annotations

import argparse
import glob
import os
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="brindle")
    p.add_argument("--tables", help="folder of NAME.parquet, each registered as a view")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--master")
    a = p.parse_args(argv)
    from brindle.plans.frontend import split, sql
    from brindle.session import session
    from brindle.sources import tvf

    spark = session(a.master or os.environ.get("SPARK_MASTER") or "local[*]")
    tvf.register(spark)
    for f in sorted(glob.glob(f"{a.tables}/*.parquet")) if a.tables else []:
        spark.read.parquet(f).createOrReplaceTempView(os.path.basename(f)[: -len(".parquet")])
    texts = [open(f, encoding="utf-8").read() for f in a.file] + a.query
    for s in (s for t in texts for s in split(t)):
        for row in sql(spark, s).toLocalIterator():
            sys.stdout.write("\t".join("NULL" if v is None else str(v) for v in row) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
