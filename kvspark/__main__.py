"""python -m kvspark --dir DIR get KEY | put KEY VALUE | delete KEY | flush | compact"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kvspark.errors import NotFound
from kvspark.sources.options import Options
from kvspark.sources.table import KVTable


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kvspark")
    parser.add_argument("--dir", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, operands in (("get", ["key"]), ("put", ["key", "value"]), ("delete", ["key"]), ("flush", []), ("compact", [])):
        sub = commands.add_parser(name)
        for operand in operands:
            sub.add_argument(operand)
    asked = parser.parse_args(args)
    session = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    with KVTable.open(session, asked.dir, Options(create_if_missing=True, reuse_logs=True)) as table:
        if asked.command == "get":
            try:
                print(table.get(asked.key.encode()).decode(errors="replace"))
            except NotFound:
                print("not found", file=sys.stderr)
                return 1
        elif asked.command == "put":
            table.put(asked.key.encode(), asked.value.encode())
        elif asked.command == "delete":
            table.delete(asked.key.encode())
        elif asked.command == "flush":
            table.flush()
        else:
            table.compact_range()
    return 0


if __name__ == "__main__":
    sys.exit(main())
