"""`python -m tickloom.cli COMMAND ...`: the operators on one trace from the command line.

Exit codes: 0 done, 1 an error, 2 a wrong command, 3 a recovery that dropped bytes.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.api import LISTING, Trace, convert, read_trace
from tickloom.sources import container, vcd


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, window: bool = False, **options):
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        if window:
            c.add_argument("--from", dest="first", type=int)
            c.add_argument("--to", dest="last", type=int)
            c.add_argument("--max", type=int, default=LISTING)
        for flag, how in options.items():
            c.add_argument(f"--{flag}", **how)

    yes = {"action": "store_true"}
    command("info", "file")
    command("hierarchy", "file", depth={"type": int}, vars=yes, sizes=yes)
    command("value", "file", "signal", "time")
    command("changes", "file", "signal", window=True)
    command("transactions", "file", window=True, scope={}, id={"type": int})
    command("logs", "file", window=True, scope={}, severity={"type": int, "default": 0}, sites=yes)
    command("clocks", "file")
    command("convert", "file", "target")
    command("to-vcd", "file", "target")
    command("recover", "file", "target")
    command("index", "file", "target", check=yes)
    command("active", "file", window=True, index={})
    command("validate", "file", complete=yes)
    return p


def show(df: DataFrame, most: int = LISTING) -> list[str]:
    """Rows as lines of tab-separated text, with the number left out at the end."""
    rows = df.limit(most + 1).collect()
    out = ["\t".join("" if v is None else str(v) for v in r) for r in rows[:most]]
    return out if len(rows) <= most else [*out, f"... {df.count() - most} more"]


def run(spark: SparkSession, argv: list[str]) -> tuple[int, list[str]]:
    """The exit code and the lines of a command."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return (0 if not e.code else 2), []
    try:
        if a.command == "recover":
            dropped = container.recover(a.file, a.target)
            return (3 if dropped else 0), [f"{dropped} bytes dropped"]
        if a.command == "convert":
            convert(spark, a.file, a.target)
            return 0, []
        if a.command == "to-vcd":
            vcd.write_vcd(vcd.read_vcd(spark, a.file), a.target)
            return 0, []
        return 0, _asked(read_trace(spark, a.file), a)
    except Exception as e:
        return 1, [f"error: {e}"]


def _asked(t: Trace, a: argparse.Namespace) -> list[str]:
    if a.command == "info":
        return show(t.info().orderBy("what"))
    if a.command == "hierarchy":
        if a.sizes:
            return show(t.scope_sizes().orderBy("node_id"))
        return show(t.listing(a.depth, a.vars).select("node_id", "node_kind", "path"), 1 << 30)
    if a.command == "value":
        return show(t.value(a.signal, int(a.time)).select("value"))
    if a.command == "changes":
        return show(t.changes(a.signal, a.first, a.last).orderBy("time", "seq").select("time", F.coalesce("text", F.col("real").cast("string"))), a.max)
    if a.command == "transactions":
        if a.id is not None:
            found = t.lookup(t.spark.createDataFrame([(a.id,)], "id long"))
            own = t.table("located").filter(F.col("parent") == a.id).select("id", "kind", "begin", "end").orderBy("id")
            return show(found) + show(own) + show(t.relations(a.id).select("kind", "source", "destination"))
        return show(t.transactions(a.first, a.last, a.scope).select("id", "generator", "parent", "begin", "end", "status").orderBy("begin", "id"), a.max)
    if a.command == "logs":
        if a.sites:
            return show(t.sites())
        return show(t.logs(a.severity, a.first, a.last, a.scope).select("id", "generator", "begin", "severity"), a.max)
    if a.command == "clocks":
        return show(t.clock_stretches().orderBy("clock", "begin"))
    if a.command == "index":
        if a.check:
            t.load_index(a.target)
            return ["fresh"]
        t.index(a.target)
        return []
    if a.command == "active":
        known = t.load_index(a.index)[0] if a.index else None
        low, high = -(1 << 62) if a.first is None else a.first, 1 << 62 if a.last is None else a.last
        return show(t.active(low, high, known).orderBy("path").select("path"), a.max)
    return show(t.validate(a.complete))


def main() -> int:
    spark = SparkSession.builder.appName("tickloom").getOrCreate()
    code, lines = run(spark, sys.argv[1:])
    print("\n".join(lines), file=sys.stderr if code == 1 else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main())
