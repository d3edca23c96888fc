"""A shell for the engine: ``python -m tarn.cli`` or ``python -m tarn.cli -ej "select ...;"``."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from tarn.engine import Engine
from tarn.errors import QueryError
from tarn.functions.registry import AGGREGATES, SCALARS
from tarn.plans.parser import TABLE_TYPES, WORDS

SIZED_ROWS = 1000


def table(names: list[str], rows: Iterable[tuple], out=None) -> int:
    """Prints rows under their names; widths are those of the first SIZED_ROWS rows. Returns their number."""
    out = out or sys.stdout
    rows = iter(rows)
    head = [tuple("NULL" if c is None else str(c) for c in r) for r in itertools.islice(rows, SIZED_ROWS)]
    widths = [max([len(n), *(len(r[i]) for r in head)]) for i, n in enumerate(names)]
    show = lambda cells: print(" | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip(), file=out)
    show(names)
    print("-+-".join("-" * w for w in widths), file=out)
    n = 0
    for r in itertools.chain(head, (tuple("NULL" if c is None else str(c) for c in r) for r in rows)):
        show(r)
        n += 1
    return n


def batch(engine: Engine, text: str) -> str:
    """The rows as a JSON array of arrays."""
    return "[" + ",".join(r.value for r in engine.json(text).collect()) + "]"


# The terminal's colours for the kinds of words.
COLOURS = {"word": "\x1b[1;34m", "name": "\x1b[35m", "text": "\x1b[32m", "number": "\x1b[36m", "note": "\x1b[2m"}
_PARTS = re.compile(r"(?P<note>--[^\n]*)|(?P<text>'[^']*'?|\"[^\"]*\"?)|(?P<quoted>`[^`]*`?)|(?P<number>\b\d+(?:\.\d*)?)|(?P<word>[A-Za-z_]\w*)")


def highlighted(text: str) -> str:
    """A statement with reserved words, functions, texts, numbers and comments in colours of their own."""

    def one(m: re.Match) -> str:
        kind, part = m.lastgroup, m[0]
        if kind == "word" and part.lower() not in WORDS and part.lower() not in TABLE_TYPES:
            kind = "name" if part.lower() in SCALARS or part.lower() in AGGREGATES else None
        return f"{COLOURS[kind]}{part}\x1b[0m" if kind in COLOURS else part

    return _PARTS.sub(one, text)


def _recolour(text: str) -> None:
    """Prints the statement just typed again, over itself, in colours."""
    lines = text.rstrip("\n").split("\n")
    shown = highlighted("\n".join(f"{'     > ' if i else 'tarn > '}{x}" for i, x in enumerate(lines)))
    print(f"\x1b[{len(lines)}A\x1b[J{shown}")


def run(engine: Engine, text: str) -> None:
    began, sc = time.time(), engine.spark.sparkContext
    try:
        sc.setJobGroup("shell", text, interruptOnCancel=True)
        df = engine.text(text)
        n = table(df.columns, df.toLocalIterator())
        print(f"{n} rows returned in {time.time() - began:.1f} seconds")
    except KeyboardInterrupt:
        sc.cancelJobGroup("shell")
        print("cancelled")
    except QueryError as e:
        print(f"error: {e}")


def repl(engine: Engine) -> None:
    try:
        import readline

        history = os.path.expanduser("~/.tarn_history")
        if os.path.exists(history):
            readline.read_history_file(history)
        atexit.register(readline.write_history_file, history)
    except (ImportError, OSError):
        pass
    held = ""
    while True:
        try:
            held += input("     > " if held else "tarn > ") + "\n"
        except EOFError:
            return
        except KeyboardInterrupt:
            held = ""
            print()
            continue
        if ";" in held:
            if sys.stdout.isatty() and sys.stdin.isatty():
                _recolour(held)
            run(engine, held)
            held = ""


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("tarn").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    if args[:1] == ["-ej"] and len(args) == 2:
        try:
            print(batch(engine, args[1]))
        except QueryError as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        return 0
    if args:
        print(__doc__)
        return 2
    repl(engine)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
