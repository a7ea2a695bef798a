"""Command line: ``python -m quayside.cli load|totals|report ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quayside import session
from quayside.operators import marts
from quayside.plans import report
from quayside.plans.frames import Frames
from quayside.sources import documents, load, trips


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quayside")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("load", help="load raw monthly files into a store; unchanged ones are skipped")
    one.add_argument("raw")
    one.add_argument("store")
    one.add_argument("--force", action="store_true", help="load unchanged files, too")
    one.add_argument("--months", type=int, help="the first so many files only")
    two = commands.add_parser("totals", help="the best cells and the totals of a store")
    two.add_argument("store")
    two.add_argument("zones", help="zone lookup CSV")
    two.add_argument("--months", type=int, help="the first so many periods only")
    two.add_argument("--top", type=int, default=8)
    two.add_argument("--verify", action="store_true", help="hold the totals of the cells against those of the trips; exit status 1 if they differ")
    three = commands.add_parser("report", help="write summary.json and backtest.json of a folder of order tables")
    three.add_argument("folder")
    three.add_argument("out")
    three.add_argument("--rounds", type=int, default=300, help="boosting rounds")
    return parser


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = _parser().parse_args(args)
    spark = spark or session.build()
    if given.command == "load":
        done = load.load_folder(spark, given.raw, given.store, given.force, given.months)
        for x in done:
            print(f"{x.period} {x.source_rows} read, {x.loaded_rows} kept, {x.excluded_rows} left out{', unchanged' if x.skipped else ''}")
        print(json.dumps(load.load_summary(done)))
        return 0
    if given.command == "totals":
        stored = trips.stored_trips(spark, f"{given.store}/trips")
        if given.months:
            first = sorted(str(r[0]) for r in stored.select("period").distinct().collect())[: given.months]
            stored = stored.where(F.col("period").isin(*first))
        zones = trips.read_zones(spark, given.zones)
        fact = trips.fact_trips(stored)
        cells = marts.cell_mart(fact, zones)
        for r in marts.top(cells, "revenue_per_driver_hour", given.top, "zone_id", "dow", "hour").collect():
            print(f"{r['zone_name']} day {r['dow']} hour {r['hour']}: {r['trips']} trips, {r['revenue_per_driver_hour'] or 0:.2f} an hour")
        found = marts.cell_totals(cells).first().asDict()
        print(json.dumps(found))
        if given.verify:
            known = marts.fact_totals(fact.join(zones.select(F.col("zone_id").alias("pickup_zone_id")), "pickup_zone_id", "left_semi")).first().asDict()
            same = all(abs((found[k] or 0) - (known[k] or 0)) <= 1e-9 * abs(known[k] or 0) + 1e-6 for k in known)
            print("totals agree" if same else f"totals differ from {json.dumps(known)}")
            return 0 if same else 1
        return 0
    frames = Frames(spark, given.folder)
    documents.write(spark, report.summary(frames, trips.UNKNOWN_NATIONS, given.rounds), f"{given.out}/summary.json")
    documents.write(spark, report.backtest_report(frames), f"{given.out}/backtest.json")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
