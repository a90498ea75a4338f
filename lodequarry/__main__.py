"""python -m lodequarry: analyze, export-perfetto, import-inference, export-inference, query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodequarry")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("analyze", help="derive the relations of a profile")
    a.add_argument("source"), a.add_argument("--output", required=True), a.add_argument("--rules-config")
    e = sub.add_parser("export-perfetto", help="write a trace for the viewer")
    e.add_argument("timeline"), e.add_argument("output"), e.add_argument("--gzip", action="store_true")
    i = sub.add_parser("import-inference", help="import a folder of log segments")
    i.add_argument("folder"), i.add_argument("store"), i.add_argument("--checkpoint", required=True), i.add_argument("--follow", action="store_true")
    x = sub.add_parser("export-inference", help="spans as HTML")
    x.add_argument("store"), x.add_argument("output")
    q = sub.add_parser("query", help="rows of a query or a recipe as JSON lines")
    q.add_argument("timeline"), q.add_argument("--sql"), q.add_argument("--recipe"), q.add_argument("--limit", type=int, default=1000)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lodequarry").getOrCreate()
    from lodequarry.plans import sinks, timeline
    from lodequarry.streaming import imports

    if args.what == "analyze":
        timeline.analyze(spark, args.source, args.output, args.rules_config)
    elif args.what == "export-perfetto":
        sinks.write_perfetto(spark.read.parquet(f"{args.timeline}/event"), args.output, args.gzip)
    elif args.what == "import-inference":
        imports.follow(spark, args.folder, args.store, args.checkpoint, every="1 second" if args.follow else None).awaitTermination()
    elif args.what == "export-inference":
        with open(args.output, "w") as f:
            f.write(sinks.spans_html(imports.spans(spark, args.store)))
    else:
        t = timeline.Timeline(spark, sinks.opened(spark, args.timeline))
        for row in t.sql(args.sql, limit=args.limit) if args.sql else t.recipe(args.recipe, args.limit):
            print(json.dumps(row, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
