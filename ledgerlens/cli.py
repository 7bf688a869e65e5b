"""Commands over a folder of tables: ``python -m ledgerlens.cli --tables FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame

from ledgerlens.engine import Engine
from ledgerlens.session import build_session
from ledgerlens.sources.config import load_config

#: Rows that a table shows at most.
SHOWN = 200


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens")
    p.add_argument("--tables", required=True, help="folder of the tables")
    p.add_argument("--json", action="store_true", help="one JSON object a line")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *words: str, **options: dict) -> None:
        own = sub.add_parser(name)
        for w in words:
            own.add_argument(w)
        for k, o in options.items():
            own.add_argument(f"--{k.replace('_', '-')}", **o)

    command("ingest", "config", reprocess={"action": "store_true"})
    command("verify", "config")
    command("enrich", "case", all={"action": "store_true"})
    command("models")
    command("build", "case")
    command("query-entity", "case", "name")
    command("evidence-pack", "case", entity={}, start={"type": float}, end={"type": float}, only_conflicts={"action": "store_true"})
    command("node-edges", "case", "node")
    command("list-identities", "case")
    command("query-identity", "case", "identity")
    command("ask", "case", "question")
    command("search", "words", case={}, mode={"default": "hybrid"}, limit={"type": int, "default": 40})
    command("sync", "case")
    command("timeline", "case", limit={"type": int, "default": 500})
    command("cases")
    command("delete", "case")
    command("summary")
    return p


def run(e: Engine, a: argparse.Namespace) -> DataFrame | str:
    case = e.case_id(a.case) if getattr(a, "case", None) else None
    calls = {
        "ingest": lambda: e.ingest(load_config(a.config), a.reprocess), "verify": lambda: e.verify(load_config(a.config)), "enrich": lambda: e.enrich(case, not a.all),
        "models": lambda: "\n".join(f"{k}: {v}" for k, v in e.models.availability().items()), "build": lambda: "\n".join(f"{s.step}: {s.state} {s.detail}".rstrip() for s in e.build(case)),
        "query-entity": lambda: e.query_entity(case, a.name), "evidence-pack": lambda: e.evidence_pack(case, a.entity, a.start, a.end, a.only_conflicts), "node-edges": lambda: e.node_edges(case, a.node),
        "list-identities": lambda: e.identities(case), "query-identity": lambda: e.query_identity(case, a.identity), "ask": lambda: e.ask(case, a.question), "search": lambda: e.search(a.words, a.mode, case, a.limit),
        "sync": lambda: e.sync_status(case), "timeline": lambda: e.timeline(case, a.limit), "cases": e.cases, "delete": lambda: e.delete_case(case) or "deleted", "summary": e.summary,
    }
    return calls[a.command]()


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        got = run(Engine(spark, a.tables), a)
    except (KeyError, ValueError) as e:
        print(str(e).strip("'\""), file=sys.stderr)
        return 1
    if isinstance(got, str):
        print(got)
    elif a.json:
        for line in got.limit(SHOWN).toJSON().collect():
            print(line)
    else:
        got.show(SHOWN, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
