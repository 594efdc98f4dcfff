"""Builds the graph, or runs the engine on a text, on a table of dialogue, or on one of the registered queries."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from causegraph.plans import inference, settings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causegraph", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--text", help="one text")
    source.add_argument("--input", help="Parquet with conv_id, turn and text")
    source.add_argument("--query", help="a registered query's name")
    source.add_argument("--build", metavar="DIR", help="folder of the sources' files; writes the graph to --output")
    parser.add_argument("--strict", action="store_true", help="with --build: contradictions and missing nodes are errors")
    parser.add_argument("--language", default="en", help="language of the texts")
    parser.add_argument("--trace", help="folder that gets each result as a JSON line, appended")
    parser.add_argument("--data", help="folder of the tables, for --query")
    parser.add_argument("--min-words", type=int, default=None)
    parser.add_argument("--output", help="Parquet folder; printed without it")
    args = parser.parse_args(argv)
    config = settings.Settings.load()
    spark = settings.session(config)
    if args.build:
        if not args.output:
            parser.error("--build needs --output")
        from causegraph.plans.build import build

        shown = build(spark, args.build, args.output, strict=args.strict)
        args.output = None
        out = shown
    elif args.query:
        from causegraph import catalog, queries  # noqa: F401

        if not args.data:
            parser.error("--query needs --data")
        out = catalog.QUERIES[args.query](spark, args.data)
    elif args.text is not None:
        out = inference.run_text(spark, args.text).withColumn("language", F.lit(args.language))
    else:
        least = config.min_words if args.min_words is None else args.min_words
        out = inference.run_gated(spark.read.parquet(args.input), "conv_id", "turn", least)
    if args.trace:
        from causegraph.sources import sinks

        sinks.trace(out, args.trace)
    if args.output:
        out.write.mode("overwrite").parquet(args.output)
    else:
        for row in out.select(F.to_json(F.struct("*"))).toLocalIterator():
            print(json.dumps(json.loads(row[0]), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
