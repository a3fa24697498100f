"""Command line: registered queries, projects, and reports over stored research tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import changes, evidence, lineage, memory, resolution, store
from .plans import project, search_plan

TABLES = (
    "domains", "page_visits", "feeds", "domain_discoveries", "observations", "entities", "runs", "feed_snapshots", "field_evidence",
    "entity_clusters", "entity_cluster_members", "entity_resolution_events", "entity_cluster_merge_events")
STATUSES = ("candidate", "active", "blocked", "rejected")
Parts = Mapping[str, DataFrame]


class Stored(Mapping):
    """Research tables of a folder, one folder a table, or those derived from the driver's tables; read on use."""

    def __init__(self, spark, folder: str, derived: bool):
        self.spark, self.folder, self.derived = spark, folder, derived

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if self.derived:
            from .plans.views import table

            return table(self.spark, self.folder, name)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def _memory(t: Parts, a: argparse.Namespace) -> Parts:
    sources = memory.source_profiles(*[t[n] for n in ("domains", "page_visits", "feeds", "domain_discoveries", "observations", "entities")], a.project, a.limit, a.stale_after_days)
    return {"queries": memory.query_memory(t["domain_discoveries"], a.project, a.limit), "duplication": memory.search_duplication(t["runs"], a.project), "runs": memory.recent_search_runs(t["runs"], a.project, a.limit), "sources": sources}


def _merge(t: Parts, a: argparse.Namespace) -> Parts:
    """The tables after a merge; with --out they are written there, else only the audit is shown."""
    facts = t["entities"].withColumn("ord", F.xxhash64("entity_key")) if "ord" not in t["entities"].columns else t["entities"]
    verdict = resolution.merge_verdict(memory.of_project(t["entity_clusters"], a.project), memory.of_project(t["entity_cluster_members"], a.project), resolution.identities(memory.of_project(facts, a.project)), a.source, a.target)
    last = t["entity_cluster_merge_events"].agg(F.max("id").alias("id")).first().id or 0
    after = lineage.apply_merge(t, a.project, a.source, a.target, verdict, datetime.now(timezone.utc), last + 1)
    if a.out:
        for name, rows in after.items():
            rows.write.mode("errorifexists").parquet(f"{a.out}/{name}")
    return {"merge_event": after["entity_cluster_merge_events"].where(F.col("id") == last + 1)}


#: What each report shows, by command.
REPORTS: dict[str, Callable[[Parts, argparse.Namespace], Parts]] = {
    "domains": lambda t, a: {"domains": memory.listing(t["domains"], a.project, [F.desc("relevance_score"), F.col("domain")], status=a.status), "counts": memory.counts_by(t["domains"], a.project, "status")},
    "discoveries": lambda t, a: {"discoveries": memory.listing(t["domain_discoveries"], a.project, [F.desc("id")], a.limit, action=a.action), "counts": memory.counts_by(t["domain_discoveries"], a.project, "action")},
    "feeds": lambda t, a: {"feeds": memory.listing(t["feeds"], a.project, [F.col("domain"), F.col("feed_url")], status=a.status)},
    "memory": _memory,
    "explain": lambda t, a: lineage.explain_domain(t, a.project, a.domain, limit=a.limit),
    "evidence-quality": lambda t, a: {"totals": evidence.project_totals(t["field_evidence"], a.project), "fields": evidence.by_field(t["field_evidence"], a.project), "methods": evidence.by_method(t["field_evidence"], a.project)},
    "clusters": lambda t, a: {"clusters": lineage.clusters(t, a.project)},
    "explain-cluster": lambda t, a: lineage.explain_cluster(t, a.project, a.cluster),
    "merge-clusters": _merge,
    "cluster-merges": lambda t, a: {"merges": lineage.merge_events(t["entity_cluster_merge_events"], a.project, a.limit)},
    "review-queue": lambda t, a: {"review": lineage.review_queue(t, a.project, a.kind, a.limit)},
    "diff": lambda t, a: {"changes": changes.ordered(changes.compare_runs(t, a.project, a.run_a, a.run_b))},
    "trace": lambda t, a: lineage.trace_run(t, a.project, a.run),
}
#: Options of the reports beyond --project and --tables.
OPTIONS: dict[str, dict[str, dict]] = {
    "domains": {"--status": {"choices": STATUSES}},
    "discoveries": {"--action": {"choices": ("recorded", "activated", "blocked", "known")}, "--limit": {"type": int, "default": 50}},
    "feeds": {"--status": {}},
    "memory": {"--limit": {"type": int, "default": 10}, "--stale-after-days": {"type": float, "default": memory.STALE_AFTER_DAYS}},
    "explain": {"--domain": {"required": True}, "--limit": {"type": int, "default": 8}},
    "explain-cluster": {"--cluster": {"required": True}},
    "merge-clusters": {"--source": {"required": True}, "--target": {"required": True}, "--out": {}},
    "cluster-merges": {"--limit": {"type": int, "default": 50}},
    "review-queue": {"--kind": {"choices": ("all", "ambiguous", "conflict"), "default": "all"}, "--limit": {"type": int, "default": 50}},
    "diff": {"--run-a": {"type": int, "required": True}, "--run-b": {"type": int, "required": True}},
    "trace": {"--run": {"type": int, "required": True}},
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="basaltine")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    sub.add_parser("templates")
    sub.add_parser("presets")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    create = sub.add_parser("create")
    create.add_argument("--preset", required=True, choices=sorted(project.PRESETS))
    create.add_argument("--output", required=True)
    check = sub.add_parser("validate")
    check.add_argument("path")
    words = sub.add_parser("queries")
    words.add_argument("path")
    words.add_argument("--limit", type=int, default=10)
    copy = sub.add_parser("migrate-db")
    copy.add_argument("--from-db", required=True)
    copy.add_argument("--to-db", required=True)
    copy.add_argument("--force", action="store_true")
    for name in REPORTS:
        report = sub.add_parser(name)
        report.add_argument("--project", required=True)
        report.add_argument("--tables", required=True)
        report.add_argument("--derived", action="store_true", help="derive the research tables from the driver's tables")
        for option, how in OPTIONS.get(name, {}).items():
            report.add_argument(option, **how)
    return parser


def show(parts: Parts) -> None:
    """Rows of all parts as JSON lines, streamed a partition at a time."""
    for name, rows in parts.items():
        print(f"# {name}")
        for (line,) in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator():
            print(line)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command in ("validate", "queries"):
        try:
            found = project.load(args.path)
        except (OSError, ValueError, TypeError) as error:
            print(error, file=sys.stderr)
            return 2
        print("\n".join(search_plan.plan(found.keywords, limit=args.limit)) if args.command == "queries" else f"{found.project_id}: ok")
        return 0
    if args.command == "create":
        project.save(project.preset(args.preset), args.output)
        return 0
    if args.command in ("templates", "presets"):
        print("\n".join(f"{k}: {'ready' if k in project.RUNNABLE else 'planned'}" for k in project.TEMPLATES) if args.command == "templates" else "\n".join(sorted(project.PRESETS)))
        return 0
    from .plans.catalog import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    if args.command == "run" and args.query not in QUERIES:
        print(f"no query named {args.query}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "migrate-db":
        store.copy_database(args.from_db, args.to_db, spark, TABLES, args.force)
        return 0
    if args.command in REPORTS:
        try:
            show(REPORTS[args.command](Stored(spark, args.tables, args.derived), args))
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        return 0
    result = QUERIES[args.query](spark, args.tables)
    result.write.parquet(args.out) if args.out else result.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
