"""Command line: ``python -m litmill.cli <command> ...``. Exit codes: 1 missing input, empty result or row errors; 2 a
bad option."""

from __future__ import annotations

import argparse
import sys

from litmill.session import make_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="litmill")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("harvest", help="parse landed articles into buckets")
    x.add_argument("--landed", required=True)
    x.add_argument("--journals", required=True, help="JSON of slug to search terms")
    x.add_argument("--years", nargs=2, type=int, required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--client", help="what makes the client, as module:function")
    x.add_argument("--rate", type=float, help="requests a second of each task")
    x = c.add_parser("demo", help="a small corpus of one journal")
    x.add_argument("--landed", required=True)
    x.add_argument("--journal", required=True)
    x.add_argument("--years", nargs=2, type=int, required=True)
    x.add_argument("--out", required=True)
    x.add_argument("-n", type=int, default=100)
    x = c.add_parser("enrich", help="enrichment tables from landed works")
    x.add_argument("--works", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--only", nargs="*")
    x.add_argument("--skip", nargs="*", default=[])
    x.add_argument("--merge", action="store_true")
    x = c.add_parser("embed", help="vectors of papers")
    x.add_argument("--papers", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--model", default="mpnet")
    x.add_argument("--limit", type=int)
    x.add_argument("--dry-run", action="store_true")
    x = c.add_parser("index", help="an index for nearest neighbours, and vectors with dense row ids")
    x.add_argument("--embeddings", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--m", type=int, default=32)
    x.add_argument("--ef-construction", type=int, default=200)
    x = c.add_parser("topics", help="sweep, fit and hierarchy")
    x.add_argument("--embeddings", required=True)
    x.add_argument("--papers", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--min-cluster", nargs="*", type=int, default=[80])
    x = c.add_parser("sample", help="stratified sample to label")
    x.add_argument("--papers", required=True)
    x.add_argument("--topics")
    x.add_argument("--out", required=True)
    x.add_argument("-n", type=int, default=500)
    x.add_argument("--seed", type=int, default=20260522)
    x = c.add_parser("export-labels", help="a rater's sheet as CSV")
    x.add_argument("--sample", required=True)
    x.add_argument("--rater", required=True)
    x.add_argument("--out", required=True)
    x = c.add_parser("import-labels", help="a filled sheet into the label table")
    x.add_argument("--sheet", required=True)
    x.add_argument("--labels", required=True)
    x.add_argument("--out", required=True)
    x = c.add_parser("pilot", help="labels by a model")
    x.add_argument("--sample", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("-n", type=int, default=50)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import functions as F

    from litmill.operators import index, labels, topics
    from litmill.plans import jobs
    from litmill.sources import services, tables
    from litmill.sources.search import ArticleSource

    spark = make_session("litmill", spark__ui__enabled="false")
    for name in ("papers", "embeddings", "sample", "works", "sheet", "topics"):
        path = getattr(args, name, None)
        if path and not tables.exists(spark, path):
            print(f"nothing at {path}", file=sys.stderr)
            return 1
    if args.command == "harvest":
        spark.dataSource.register(ArticleSource)
        source = spark.read.format("articles").option("path", args.landed).option("journals", args.journals).option("first_year", args.years[0]).option("last_year", args.years[1])
        source = source.option("client", args.client) if args.client else source
        source = source.option("rate", args.rate) if args.rate else source
        print(jobs.harvest(source.load(), args.out))
    elif args.command == "demo":
        counts = jobs.demo(spark, args.landed, args.out, args.journal, *args.years, args.n)
        print(counts)
        return 0 if counts["papers"] else 1
    elif args.command == "enrich":
        works = spark.read.text(args.works, wholetext=True)
        rows = works.select(F.explode(F.from_json("value", "results array<string>").getField("results")).alias("j")).select(F.from_json("j", services.WORK).alias("w")).select("w.*")
        try:
            print(jobs.enrich(spark, args.out, rows, only=set(args.only) if args.only else None, skip=set(args.skip), merge=args.merge))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    elif args.command == "embed":
        papers = tables.read(spark, args.papers)
        try:
            out = jobs.embed(papers, args.model, args.limit)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        n = out.select("pmid").count()
        print(f"{n} papers")
        if not n:
            return 1
        if not args.dry_run:
            out.write.mode("overwrite").parquet(args.out)
            tables.record_run(args.out, [args.papers], vars(args))
    elif args.command == "index":
        vectors = spark.read.parquet(args.embeddings)
        try:
            index.save(index.build(vectors, args.m, args.ef_construction), f"{args.out}/index")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        tables.save_index(vectors, f"{args.out}/rows")
    elif args.command == "topics":
        result = jobs.topic_model(spark.read.parquet(args.embeddings), tables.read(spark, args.papers), topics.grid(topics.TopicConfig(), min_cluster_size=args.min_cluster))
        for name, df in result.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    elif args.command == "sample":
        known = spark.read.parquet(args.topics) if args.topics else None
        try:
            labels.stratified(tables.read(spark, args.papers), known, args.n, args.seed).write.mode("overwrite").parquet(args.out)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif args.command == "export-labels":
        tables.write_csv(labels.sheet(spark.read.parquet(args.sample), args.rater), args.out)
    elif args.command == "import-labels":
        header = ["pmid", "rater", "title", "abstract", *labels.FIELDS, "notes"]
        old = tables.read_optional(spark, args.labels, "epistemic_handlabel")
        merged, errors, summary = labels.import_sheet(tables.read_labels_csv(spark, args.sheet, header).withColumn("pmid", F.col("pmid").cast("long")), old)
        merged.write.mode("overwrite").parquet(args.out)
        print(summary)
        return 1 if summary["n_errors"] else 0
    elif args.command == "pilot":
        good, bad = jobs.pilot(spark.read.parquet(args.sample), "Label the study as one JSON object.", args.n)
        tables.write_table(good, args.out, "epistemic_pilot")
        tables.write_table(bad, args.out, "epistemic_pilot_failed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
