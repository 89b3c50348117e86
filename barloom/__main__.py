"""python -m barloom scan|backtest|diagnose DATA_DIR [--as-of DAY] [--top N] [--out PATH]"""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import series as S
from .operators import diagnostics, indicators, metrics
from .operators.validate import profile, valid
from .params import TagParams
from .plans import backtest, report, scan
from .sources import bars as B


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom", description=__doc__)
    parser.add_argument("task", choices=["scan", "backtest", "diagnose"])
    parser.add_argument("data")
    parser.add_argument("--as-of")
    parser.add_argument("--top", type=int, default=15)
    parser.add_argument("--out", help="an HTML file; by default tables are printed")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("barloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    b = B.weekly(spark, args.data)
    if args.task == "scan":
        top = scan.unusual(b, args.as_of, dataclasses.replace(TagParams(), results=args.top))
        tables = {"Unusual activity": top.select(report.scan_line().alias("line"))}
    elif args.task == "backtest":
        signals = backtest.rules(b).persist()
        tables = {"Folds": metrics.per_fold(signals), "All": metrics.overall(signals), "Scores": metrics.buckets(signals, metrics.RULE_BUCKETS)}
    else:
        rows = indicators.compute(valid(b)).persist()
        ahead = rows.withColumn("r3", S.forward_return("close", 3))
        ic = diagnostics.rank_correlation(ahead, "rsi_14", "r3", ["date"])
        tables = {"Quality": profile(rows), "Correlation": diagnostics.pearson(rows, ["rsi_14", "macd_diff", "volume_ratio_20d"]), "Rank correlation": diagnostics.mean_ic(ic), "Long-run t": diagnostics.newey_west(ic)}
    if args.out:
        with open(args.out, "w", encoding="utf-8") as page:
            page.write(report.page(f"Barloom: {args.task}", tables))
        return
    for name, df in tables.items():
        print(name)
        df.select(*[F.round(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]).show(100, truncate=False)


if __name__ == "__main__":
    main()
