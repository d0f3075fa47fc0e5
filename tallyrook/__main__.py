"""Command line: python -m tallyrook COMMAND ... Each command is a function of api."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api, schemas
from .config import ClusterConfig, MineConfig, PlanConfig
from .sources import documents
from .streaming.stream import follow


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyrook", description="Mine agent-session transcripts.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, told: str, **options: object) -> None:
        """An option whose value is a type is required; others have a default."""
        sub = commands.add_parser(name, help=told)
        for key, value in options.items():
            flag = "--" + key.replace("_", "-")
            if value is False:
                sub.add_argument(flag, action="store_true")
            elif isinstance(value, type):
                sub.add_argument(flag, type=value, required=True)
            else:
                sub.add_argument(flag, type=type(value) if value is not None else str, default=value)

    command("extract", "transcripts into the incident table", corpus=str, out=str, since=None, signals="", global_artifact=None)
    command("follow", "what is new in a folder of transcripts into the incident table", corpus=str, out=str, checkpoint=str, pattern="*.jsonl", files=0, signals="", global_artifact=None)
    command("compact", "one commit of the incident table instead of many", incidents=str, older_than=86400)
    command("trend", "incidents before and after merges", incidents=str, ledger=str, states=str, out=str, days=14)
    command("summary", "incidents by signal", incidents=str)
    command("cluster", "incidents into cluster files", incidents=str, out=str, ledger="", min_sessions=5, max_incidents=50, top=0, repo="", links="")
    command("assemble", "proposal files into one, and into the ledger", proposals=str, out=str, ledger=str, date=None)
    command("facts", "what is known of proposals' paths", proposals=str, links=str, repos=str, out=str, settings_repo="")
    command("prepare", "a plan of proposals", proposals=str, facts=str, out=str, settings_repo="", open_prs="", ledger="", links="", no_dedup=False, include_low_confidence=False)
    command("suggest", "a plan as text", plan=str, proposals=str, out=str)
    command("reconcile", "states of pull requests into the ledger", ledger=str, states=str)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, object]:
    """What the command reports. Tables of proposals, facts, plans, pull requests and their
    states are JSON files."""
    rows = lambda path, schema: documents.read_json_rows(spark, path, schema)
    links = rows(args.links, schemas.LINK) if getattr(args, "links", "") else None
    if args.command in ("extract", "follow"):
        given = {"global_artifact": args.global_artifact} if args.global_artifact else {}
        mine = MineConfig(signals=tuple(s.strip() for s in args.signals.split(",") if s.strip()), **given)
    match args.command:
        case "extract":
            return {"new": api.extract(spark, args.corpus, args.out, mine, args.since)}
        case "follow":
            query = follow(spark, args.corpus, args.out, args.checkpoint, mine, args.pattern, files=args.files)
            query.awaitTermination()
            return {"lines": sum(p["numInputRows"] for p in query.recentProgress)}
        case "compact":
            table = api.sinks.incident_table(spark, args.incidents)
            return {"version": table.compact(), "removed": table.vacuum(args.older_than)}
        case "trend":
            return {"merges": api.trend(spark, args.incidents, args.ledger, rows(args.states, schemas.PR_CLOSED), args.out, args.days)}
        case "facts":
            api.facts(rows(args.proposals, schemas.PROPOSAL), links, rows(args.repos, schemas.REPO), args.out, PlanConfig(settings_repo=args.settings_repo))
            return {"out": args.out}
        case "summary":
            return {r["signal_type"]: r["n"] for r in api.summary(api.sinks.read_incidents(spark, args.incidents)).collect()}
        case "cluster":
            config = ClusterConfig(min_sessions=args.min_sessions, max_incidents=args.max_incidents, top=args.top)
            return dict(api.cluster(spark, args.incidents, args.out, args.ledger, config, args.repo, links))
        case "assemble":
            return dict(api.assemble(spark, args.proposals, args.out, args.ledger, args.date))
        case "prepare":
            config = PlanConfig(include_low_confidence=args.include_low_confidence, settings_repo=args.settings_repo)
            prs = rows(args.open_prs, schemas.OPEN_PR) if args.open_prs and not args.no_dedup else None
            ledger = documents.read_ledger(spark, args.ledger) if args.ledger and not args.no_dedup else None
            plan = api.prepare(rows(args.proposals, schemas.PROPOSAL), rows(args.facts, schemas.TARGET_FACT), args.out, config, prs, ledger, links)
            return {r["status"]: r["count"] for r in plan.groupBy("status").count().collect()}
        case "suggest":
            api.suggest(rows(args.plan, schemas.PLAN), rows(args.proposals, schemas.PROPOSAL), args.out)
            return {"out": args.out}
        case _:
            return {"changed": api.reconcile_ledger(spark, args.ledger, rows(args.states, schemas.PR_STATE))}


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tallyrook {args.command}").getOrCreate()
    try:
        print(json.dumps(run(spark, args)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
