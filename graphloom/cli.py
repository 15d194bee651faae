"""Command line: ``python -m graphloom.cli run JOB``, ``hosts STATE list|remove ID|reset``, ``query CONF OPERATION ...``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from .operators import frontier
from .plans import builtins, planner
from .plans.jobs import Runner, _swap
from .sources import rdf, store

OPERATIONS = {"has": 1, "what": 1, "type": 1, "fulltype": 1, "describe": 1, "count": 0, "tquery": 1, "gquery": 2, "rdfdump": 1}


def run(spark: SparkSession, args: list[str], out=print) -> int:
    if len(args) != 1:
        out("a job file or its folder is needed")
        return 2
    runner = Runner(args[0])
    runner.run()
    for w in runner.context.warnings:
        out(f"warning: {w}")
    return 0


def hosts(spark: SparkSession, args: list[str], out=print, ask=input) -> int:
    """``list``, ``remove ID`` or ``reset`` on the tables host, url and url_lock of a folder."""
    if len(args) < 2:
        out("a folder and list, remove or reset are needed")
        return 2
    folder, op = args[:2]
    schemas = {"host": frontier.HOST, "url": frontier.URL, "url_lock": frontier.LOCK}
    tables = [spark.read.parquet(p) if os.path.exists(p := os.path.join(folder, n)) else spark.createDataFrame([], s) for n, s in schemas.items()]
    if op == "list":
        for r in tables[0].orderBy("hostid").toLocalIterator():
            out(f"{r.hostid}\t{r.address}")
        return 0
    if op == "remove" and len(args) == 3 and args[2].isdigit():
        gone = spark.createDataFrame([(int(args[2]),)], "hostid int")
        if tables[0].join(gone, "hostid", "left_semi").isEmpty():
            out(f"no host {args[2]}")
            return 1
    elif op == "reset":
        gone = None
    else:
        out("list, remove ID or reset")
        return 2
    if ask("All its URLs go too. Continue? y/n ").strip().lower() != "y":
        return 1
    for name, left in zip(schemas, frontier.remove_hosts(*tables, gone), strict=True):
        left.write.mode("overwrite").parquet(os.path.join(folder, name + "__new"))
    for name in schemas:
        _swap(spark, os.path.join(folder, name))
    return 0


def query(spark: SparkSession, args: list[str], out=print) -> int:
    """An operation on the store that a properties file names."""
    if len(args) < 2 or args[1] not in OPERATIONS:
        out(f"a properties file and one of {', '.join(OPERATIONS)} are needed")
        return 2
    conf, op, rest = args[0], args[1], args[2:]
    if not os.path.exists(conf):
        out(f"no such file: {conf}")
        return 1
    if len(rest) < OPERATIONS[op]:
        out("Missing argument")
        return 2
    held, _, _ = store.open_store(spark, store.properties(conf), os.path.dirname(os.path.abspath(conf)))
    g = held.read()
    try:
        if op == "has":
            out(str(builtins.has_literal(g, rest[0])).lower())
        elif op == "count":
            out(f"{builtins.count(g)} explicit statements")
        elif op == "what":
            _each(builtins.what(g, rest[0]), out)
        elif op in ("type", "fulltype"):
            _each(builtins.type_of(g, rest[0], op == "type"), out)
        elif op == "describe":
            for r in builtins.describe(g, rest[0]).toLocalIterator():
                out(f"{r.isValueOf}, {r.prop}" if r.isValueOf is not None else f"{r.prop}, {r.hasValue}")
        elif op == "rdfdump":
            rdf.write_rdfxml(g.where("not inferred"), rest[0])
        else:
            with open(rest[0], encoding="utf-8") as text:
                answer = planner.select(g, text.read(), planner.predicate_counts(g))
            if op == "gquery":
                rdf.write_rdfxml(answer, rest[1])
            else:
                for r in planner.shown(answer).toLocalIterator():
                    out("[" + ";".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) + "]")
    except ValueError as problem:
        out(str(problem))
        return 1
    return 0


def _each(answer, out) -> None:
    for r in answer.orderBy(*answer.columns).toLocalIterator():
        out(r[0])


def main(args: list[str]) -> int:
    commands = {"run": run, "hosts": hosts, "query": query}
    if not args or args[0] not in commands:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return commands[args[0]](spark, args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
