"""Command line: python -m pagelattice audit|compare|trend|crawl|db|config|rules ... (no network; pages come from tables)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from pagelattice.operators import catalog, stored
from pagelattice.plans import audit, reports
from pagelattice.plans.rules import selected
from pagelattice.session import durable, get_spark
from pagelattice.sources import frontier, probes, records
from pagelattice.sources.tables import table


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="pagelattice")
    sub = top.add_subparsers(dest="what", required=True)
    a = sub.add_parser("audit", help="audit the pages of a folder of tables")
    a.add_argument("folder")
    a.add_argument("--crawl", type=int, help="crawl to report on; the smallest by default")
    a.add_argument("--categories", default="", help="comma-separated; all by default")
    a.add_argument("--format", choices=sorted(reports.FORMATS), default="console")
    a.add_argument("--out", help="file of the report")
    a.add_argument("--tables", help="folder for the result tables")
    c = sub.add_parser("compare", help="latest audit of each domain against the one before")
    c.add_argument("folder")
    t = sub.add_parser("trend", help="the last scores of each domain")
    t.add_argument("folder")
    w = sub.add_parser("crawl", help="walk the stored links breadth first")
    w.add_argument("folder")
    w.add_argument("start", nargs="+", help="urls to start from")
    w.add_argument("--max-pages", type=int, default=100)
    d = sub.add_parser("db", help="rows of each table and the storage of html")
    d.add_argument("folder")
    g = sub.add_parser("config", help="show and check the configuration that holds in a folder")
    g.add_argument("folder", nargs="?", default=".")
    r = sub.add_parser("rules", help="list the rules")
    r.add_argument("--categories", default="")
    args = top.parse_args(argv)
    chosen = tuple(x for x in getattr(args, "categories", "").split(",") if x)
    if args.what == "rules":
        for rule in selected(chosen):
            print(rule.category, rule.id, rule.weight, rule.kind)
        return 0
    if args.what == "config":
        found = records.load_config(args.folder)
        print(json.dumps(found, indent=2))
        wrong = records.check_config(found)
        print(*wrong, sep="\n", file=sys.stderr)
        return 2 if wrong else 0
    spark = get_spark()
    if args.what == "trend":
        stored.score_trend(table(spark, args.folder, "audits")).orderBy("domain", "audit_id").show(1000, False)
        return 0
    if args.what == "db":
        names = ("projects", "crawls", "pages", "links", "audits", "audit_results", "issues")
        catalog.table_counts(**{n: table(spark, args.folder, n) for n in names}).show(len(names), False)
        catalog.html_storage(table(spark, args.folder, "pages")).orderBy("crawl_id").show(1000, False)
        return 0
    if args.what == "crawl":
        pages = table(spark, args.folder, "pages").select(F.col("id").alias("page_id"), "url")
        links = table(spark, args.folder, "links").where("is_internal = 1").select("page_id", "href", F.col("id").alias("pos"))
        found = frontier.crawl(links.join(pages, "page_id").select("url", "href", "pos"), args.start, args.max_pages)
        found.orderBy("ord").show(args.max_pages, False)
        return 0
    if args.what == "compare":
        pairs = stored.audit_pairs(table(spark, args.folder, "audits"))
        stored.compare_audits(pairs, table(spark, args.folder, "audit_results")).orderBy("domain").show(1000, False)
        return 0
    pages, links = table(spark, args.folder, "pages"), table(spark, args.folder, "links")
    prepared = audit.prepare(pages)
    frames = audit.Auditor(spark, categories=chosen).audit(
        prepared, durable(probes.site_table(pages)), durable(probes.probe_table(pages, links)), durable(probes.redirect_table(pages))
    )
    if args.tables:
        reports.save(frames, args.tables, prepared)
    first = args.crawl or frames.overall.agg({"audit_id": "min"}).first()[0]
    if first is None:
        return reports.exit_code(None)
    summary = reports.summary(frames, first)
    text = reports.FORMATS[args.format](summary)
    if args.out:
        Path(args.out).write_text(text)
    else:
        print(text)
    return reports.exit_code(summary["overall_score"])


if __name__ == "__main__":
    sys.exit(main())
