"""Command line: ``python -m tessellum COMMAND``: list, run, find, neighbors, audit, store."""

from __future__ import annotations

import argparse
import sys
import time


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessellum")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries and what they do")
    run = commands.add_parser("run", help="runs a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="writes the whole result there as Parquet instead")
    find = commands.add_parser("find", help="searches the entries of a folder of tables; without words the best ones")
    find.add_argument("tables")
    find.add_argument("words", nargs="*")
    find.add_argument("--cursor")
    find.add_argument("--language")
    find.add_argument("--min-trust", choices=["high", "medium", "low"])
    near = commands.add_parser("neighbors", help="what is within some hops of an entity")
    near.add_argument("tables")
    near.add_argument("entity")
    near.add_argument("--hops", type=int, default=1, choices=range(1, 5))
    commands.add_parser("audit", help="totals of a folder of tables").add_argument("tables")
    store = commands.add_parser("store", help="adds a text (a file, or - for standard input) to a store")
    store.add_argument("root")
    store.add_argument("file")
    store.add_argument("--source-type")
    store.add_argument("--language", default="en")
    for p in (run, find, near):
        p.add_argument("--rows", type=int, default=20, help="rows to show")
    got = parser.parse_args(argv)

    from .plans import registry

    if got.command == "list":
        for name, query in sorted(registry.QUERIES.items()):
            print(f"{name}: {(query.__doc__ or '').strip()}")
        return
    from pyspark.sql import SparkSession

    from .operators import graph, ingest, retrieval, sinks
    from .sources.bindings import load

    spark = SparkSession.builder.appName("tessellum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    table = lambda name: load(spark, got.tables, name)
    now = int(time.time())
    if got.command == "run":
        result = registry.QUERIES[got.name](spark, got.tables)
        if got.out:
            result.write.parquet(got.out)
            return
    elif got.command == "find":
        if got.words:
            result = retrieval.search(table("entry"), table("entry_source"), " ".join(got.words), now, got.rows, min_trust=got.min_trust, language=got.language, cursor=got.cursor)
        else:
            result = retrieval.explore(table("entry"), table("entry_source"), now, retrieval.LEVELS.get(got.min_trust, 0.0), got.rows)
    elif got.command == "neighbors":
        root = graph.resolve(table("entity"), got.entity).first()
        if root.state != "found":
            sys.exit(f"{root.state}: {root.candidates or got.entity}")
        result = graph.neighbors(table("kg_relation"), root.id, got.hops, limit=got.rows)
    elif got.command == "audit":
        result = retrieval.audit(table("entry"), table("entry_source"), now)
    else:
        with sys.stdin if got.file == "-" else open(got.file) as f:
            raw = f.read()
        inputs = spark.createDataFrame([(f"in{now}", raw, got.source_type, got.language)], "id string, raw string, source_type string, language string")
        held = sinks.Snapshots(spark, got.root)
        version = ingest.ingest(held, inputs, now)
        print(f"version {version}")
        result = held.read("ingest_log", version).where(f"at_s = {now}")
    result.show(getattr(got, "rows", 50), truncate=80)


if __name__ == "__main__":
    main()
