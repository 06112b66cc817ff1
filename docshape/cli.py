"""python -m docshape.cli version | compile SCHEMA [QUERIES] | verify SCHEMA QUERIES | evaluate FOLDER"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.sqlfront import lex, parse_schema, split_text
from .verify import compile_schema, layouts_of, verify

VERSION = "0.1"


def statements(path: str | None) -> list[str]:
    """The statements of a file, each transaction block as one text."""
    if not path:
        return []
    out, block = [], None
    for part in split_text(Path(path).read_text()):
        word = lex(part)[0].text
        if block is not None:
            block.append(part)
            if word in ("commit", "end", "rollback"):
                out.append(";\n".join(block))
                block = None
        elif word in ("begin", "start"):
            block = [part]
        else:
            out.append(part)
    return out + ([";\n".join(block)] if block else [])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docshape")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("version")
    for verb in ("compile", "verify"):
        q = sub.add_parser(verb)
        q.add_argument("schema")
        q.add_argument("queries", nargs="?" if verb == "compile" else None)
    sub.add_parser("evaluate").add_argument("folder")
    sub.choices["evaluate"].add_argument("--fail-under", type=float, default=1.0, help="the severity accuracy below which the exit code is 1")
    sub.choices["verify"].add_argument("--fail-on", choices=("mismatch", "never"), default="mismatch")
    sub.choices["verify"].add_argument("--rows", type=int, default=50)
    sub.choices["verify"].add_argument("--seed", type=int, default=1)
    a = p.parse_args(argv)
    if a.verb == "version":
        print(VERSION)
        return 0
    if a.verb == "evaluate":
        from .plans.evaluate import evaluate, load_cases

        metrics = evaluate(load_cases(a.folder))
        print(json.dumps(metrics.summary(), indent=1))
        return int(metrics.severity < a.fail_under)
    ddl = Path(a.schema).read_text()
    if a.verb == "compile":
        out = compile_schema(ddl, statements(a.queries))
        print(json.dumps(out, indent=1))
        return int(any(d[0] == "error" for d in out["diagnostics"]))
    from pyspark.sql import SparkSession

    from .plans import placement
    from .plans.sqlfront import parse_script

    schema, queries = parse_schema(ddl)[0], statements(a.queries)
    plan = placement.plan(schema, placement.features(schema, [q for _, q in parse_script(";\n".join(queries)).statements()]))
    report = verify(SparkSession.builder.getOrCreate(), schema, layouts_of(schema, plan), queries, seed=a.seed, rows=a.rows)
    print(json.dumps({"correctness": report.correctness, "statements": [vars(o) for o in report.outcomes]}, indent=1))
    return int(report.correctness < 1 and a.fail_on == "mismatch")


if __name__ == "__main__":
    sys.exit(main())
