"""Command line: list tasks or queries, show a task's configuration, run queries over a folder of tables."""

from __future__ import annotations

import argparse
import json

from .plans import catalog


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gaugeworks", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    ls = sub.add_parser("list", help="names of queries, or of the tasks and groups of a catalogue")
    ls.add_argument("patterns", nargs="*", default=["*"])
    ls.add_argument("--tasks", metavar="FOLDER")
    show = sub.add_parser("show", help="configurations under a task, group or tag, as JSON")
    show.add_argument("name")
    show.add_argument("--tasks", metavar="FOLDER", required=True)
    show.add_argument("--set", nargs="*", default=[], metavar="KEY=VALUE", help="changes, values in JSON or plain")
    run = sub.add_parser("run", help="run queries")
    run.add_argument("patterns", nargs="+")
    run.add_argument("--data", required=True, metavar="FOLDER")
    run.add_argument("--out", metavar="FOLDER", help="write Parquet here, a folder a query, instead of showing rows")
    run.add_argument("--show", type=int, default=20, metavar="N")
    return p


def setting(text: str) -> tuple[str, object]:
    """KEY=VALUE; the value as JSON where it is that, else as it stands."""
    key, sep, value = text.partition("=")
    if not sep or not key:
        raise SystemExit(f"{text!r} is not KEY=VALUE")
    try:
        return key, json.loads(value)
    except json.JSONDecodeError:
        return key, value


def chosen(patterns: list[str], names) -> list[str]:
    """Names that match; a pattern that none matches ends the program."""
    for p in patterns:
        if not catalog.match([p], names):
            raise SystemExit(f"nothing is named {p}")
    return catalog.match(patterns, names)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "show":
        found = catalog.expand_configs(a.name, catalog.index(a.tasks), dict(map(setting, a.set)))
        print(json.dumps(found, indent=1, sort_keys=True, default=str))
        return
    if a.command == "list" and a.tasks:
        print("\n".join(chosen(a.patterns, catalog.index(a.tasks))))
        return
    from .queries import queries

    names = chosen(a.patterns, queries())
    if a.command == "list":
        print("\n".join(names))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    for name in names:
        df = queries()[name](spark, a.data)
        if a.out:
            df.write.parquet(f"{a.out}/{name}")
        else:
            print(name)
            df.show(a.show, truncate=80)


if __name__ == "__main__":
    main()
