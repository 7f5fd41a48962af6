"""``python -m finsift``: analyse facts, import benchmarks, check or show files."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    from finsift.plans import stages
    from finsift.sources import reports, settings

    p = argparse.ArgumentParser(prog="finsift", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    p.add_argument("--config", help="folder of settings in place of the built-in ones")
    a = sub.add_parser("analyze", help="extracted documents, or facts, and tags to reports")
    a.add_argument("--data", required=True, help="folder with tags, facts, and what else there is of explanations, aliases, macro_facts and searches, as Parquet; with --documents, tags are enough")
    a.add_argument("--provider", help="module:function that makes a provider of a language model; without it all goes by rule")
    a.add_argument("--cache", help="folder of answers; needed with --provider")
    a.add_argument("--per-second", type=float, help="calls that all tasks together may begin in a second")
    a.add_argument("--documents", help="folder of extracted documents, one JSON file each")
    a.add_argument("--work", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--from", dest="start", help="run this stage and those after it again, whatever is stored")
    a.add_argument("--skip", nargs="*", default=[])
    b = sub.add_parser("benchmarks", help="CSV of peer facts to partitioned Parquet")
    b.add_argument("--csv", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--industry")
    v = sub.add_parser("validate", help="which parts extracted documents have")
    v.add_argument("--data", required=True)
    s = sub.add_parser("show", help="print reports")
    s.add_argument("--data", required=True)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("finsift").getOrCreate()
    if args.config:
        settings.use(spark, args.config)
    if args.what == "analyze":
        inputs = {n: spark.read.parquet(f"{args.data}/{n}") for n in ("facts", "tags", "explanations", "aliases", "macro_facts", "searches") if reports.there(spark, f"{args.data}/{n}")}
        if args.documents:
            inputs.pop("facts", None)
            inputs["documents"] = reports.read_documents(spark, args.documents)
        how = stages.How()
        if args.provider:
            if not args.cache:
                p.error("--provider needs --cache")
            module, _, name = args.provider.partition(":")
            how = stages.How(getattr(importlib.import_module(module), name), args.cache, {"per_second": args.per_second} if args.per_second else {})
        made = stages.run(spark, inputs, args.work, args.start, tuple(args.skip), how)
        if "reports" in made:
            reports.write_reports(made["reports"], args.output)
    elif args.what == "benchmarks":
        facts = reports.read_benchmarks(spark, args.csv)
        reports.write_benchmarks(facts.where(facts.industry == args.industry) if args.industry else facts, args.output)
    elif args.what == "validate":
        reports.parts_present(reports.read_documents(spark, args.data)).show(truncate=False)
    else:
        reports.show(reports.read_reports(spark, args.data))


if __name__ == "__main__":
    main()
