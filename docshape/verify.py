"""Differential runs: every statement over a nested layout against the flat one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .model import DocshapeError, Schema
from .operators.diff import hypothesis, multiset_diff, same_multiset, same_order, sample
from .operators.dml import execute, generated, matched
from .operators.reshape import build_layouts, flatten, nest
from .plans import documents, guarantees, placement
from .plans.query import run_select
from .plans.sqlfront import Block, Select, parse_script
from .plans.validate import unknown_names, validate
from .sources.datagen import generate


#: Rows of a mismatch that are looked at for its likely reason.
SHOWN = 200


@dataclass
class Outcome:
    sql: str
    status: str  # MATCH, MISMATCH, ERROR (one side only), NOT_TRANSLATED, SKIPPED (of a block that failed before it)
    detail: str = ""
    explained_by: list[str] = field(default_factory=list)  # verdicts that foresee a mismatch
    hypothesis: str = ""
    rows: int | None = None  # of a write: the rows that it is about


@dataclass
class Report:
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def correctness(self) -> float:
        judged = [o for o in self.outcomes if o.status in ("MATCH", "MISMATCH", "ERROR")]
        return sum(o.status == "MATCH" for o in judged) / len(judged) if judged else 1.0


def compile_schema(ddl: str, queries: list[str] = (), overrides: dict[str, str] | None = None) -> dict:
    """Diagnostics, the placement and the verdicts of a schema with its workload, and what the layout asks of documents; one bad
    statement does not stop the rest.  ``queries`` may hold transaction blocks."""
    script = parse_script(";\n".join([ddl, *queries]))
    schema, parsed = script.schema, [q for _, q in script.statements()]
    known = [q for q in parsed if not unknown_names(schema, q)]
    groups = [{t for _, q in b.statements for t in guarantees.tables_of(q)} for b in script.blocks()]
    plan = placement.plan(schema, placement.features(schema, known, transactions=groups), overrides)
    layouts = layouts_of(schema, plan)
    diagnostics = [*script.diagnostics, *validate(schema), *[d for q in parsed for d in unknown_names(schema, q)]]
    found = guarantees.verdicts(schema, layouts, script.items)
    return {
        "diagnostics": [(d.severity, d.code, d.message) for d in diagnostics],
        "placement": {i: (d.decision, d.score, d.host) for i, d in plan.items()},
        "layouts": {t: (x.kind, x.host, x.path) for t, x in layouts.items()},
        "verdicts": [(v.node, v.rule, v.outcome, v.verdict) for v in found],
        "mitigations": guarantees.mitigations(found),
        "migration": documents.migration_plan(schema, layouts),
        "documents": {t: documents.document_schema(schema, layouts, t) for t, x in layouts.items() if x.kind == "root"},
        "indexes": [vars(i) for i in documents.indexes(schema, layouts)],
    }


def layouts_of(schema: Schema, plan: dict) -> dict:
    """The layouts of a plan; relationships through nullable keys stay references, so that no row is lost."""
    from .model import relationships

    nullable = {r.id for r in relationships(schema) if r.nullable}
    fold = {i.removeprefix("m2n:"): d.host for i, d in plan.items() if d.decision == "REF_ARRAY"}
    return build_layouts(schema, [i for i, d in plan.items() if d.decision == "EMBED" and i not in nullable], fold)


def order_keys(q: Select) -> list[int]:
    """The output columns that the leading ORDER BY keys are; rows that these do not tell apart may come in any order."""
    keys: list[int] = []
    for x, *_ in q.order:
        at = [x[1] - 1] if x[0] == "lit" and isinstance(x[1], int) else [i for i, (y, alias) in enumerate(q.items) if y == x or alias and x[0] == "col" and x[-1] == alias]
        if not at:
            break
        keys.append(at[0])
    return keys


def _expected(schema: Schema, layouts: dict, q) -> list[str]:
    """The verdicts that foresee another answer to a statement: of its joins and aggregates, and of keys within documents."""
    tables = set(guarantees.tables_of(q))
    found = guarantees.verdicts(schema, layouts, [q])
    return [v.node for v in found if v.verdict != guarantees.SAFE and (v.rule in ("EQ-JOIN", "EQ-AGG") or v.rule == "EQ-ENTITY-UNIQ" and v.node.removeprefix("pk:").split(".")[0] in tables)]


def _select(flat, nested, sql: str, q: Select, schema: Schema, layouts: dict) -> Outcome:
    try:
        a, b = run_select(flat, q, use_layout=False), run_select(nested, q)
        if not same_multiset(a, b):
            found = sample(multiset_diff(a, b))
            left, right = a.limit(SHOWN).collect(), b.limit(SHOWN).collect()
            sides = [[tuple(r[c] for c in a.columns) for r in left if r not in right], [tuple(r[c] for c in a.columns) for r in right if r not in left]]
            why = hypothesis(left, right, *sides, one_row=not q.group and all(x[0] == "call" for x, _ in q.items))
            return Outcome(sql, "MISMATCH", str(found), _expected(schema, layouts, q), why)
        if q.order and len(q.items) == len(a.columns) and not same_order(a.collect(), b.collect(), order_keys(q)):
            return Outcome(sql, "MISMATCH", "the order of the rows")
        return Outcome(sql, "MATCH")
    except DocshapeError as e:
        return Outcome(sql, "NOT_TRANSLATED", str(e))


def verify(spark: SparkSession, schema: Schema, layouts: dict, statements: list[str], tables: dict[str, DataFrame] | None = None, seed: int = 1, rows: int = 50) -> Report:
    """SELECTs first, then writes in order; after each write all tables are compared.  Both sides refusing is a match.

    A text that holds BEGIN .. COMMIT is a block: all its writes happen or none; those behind the one that fails are SKIPPED.
    What a write generates (times, random ids) is computed once for both sides."""
    tables = tables or generate(spark, schema, seed, rows)
    plain = build_layouts(schema, [])
    flat, nested = nest(schema, plain, tables), nest(schema, layouts, tables)
    report, writes = Report(), []
    for sql in statements:
        script = parse_script(sql)
        wrong = [d for d in script.diagnostics if d.severity == "error"]
        if wrong:
            report.outcomes.append(Outcome(sql, "NOT_TRANSLATED", wrong[0].message))
        for x in script.items:
            if not isinstance(x, Block) and isinstance(x[1], Select):
                report.outcomes.append(_select(flat, nested, sql, x[1], schema, layouts))
            else:
                writes.append((sql, [q for _, q in x.statements if not isinstance(q, Select)] if isinstance(x, Block) else [x[1]]))
    for sql, block in writes:
        sides, errors, n, done = [flat, nested], [], 0, 0
        for q in block:
            after = []
            try:
                q = generated(flat, q)
                counts = [matched(c, q) for c in sides]
                n += counts[0]
            except DocshapeError:
                counts = [0, 0]
            for cat in sides:
                try:
                    after.append(execute(cat, q))
                except DocshapeError as e:
                    errors.append(str(e))
            if errors or counts[0] != counts[1]:
                break
            sides, done = after, done + 1
        else:
            counts = [0, 0]
        if len(errors) == 1 or counts[0] != counts[1]:
            report.outcomes.append(Outcome(sql, "ERROR", errors[0] if errors else f"{counts[0]} rows on one side, {counts[1]} on the other", rows=n))
        elif errors:
            report.outcomes.append(Outcome(sql, "MATCH", "; ".join(errors), rows=0))
        else:
            wrong = [t for t in tables if not same_multiset(flatten(sides[0], t), flatten(sides[1], t))]
            if wrong:
                report.outcomes.append(Outcome(sql, "MISMATCH", f"tables {', '.join(wrong)}", sorted({v for q in block for v in _expected(schema, layouts, q)}), rows=n))
            else:
                report.outcomes.append(Outcome(sql, "MATCH", rows=n))
            flat, nested = sides if not wrong else (sides[0], nest(schema, layouts, {t: flatten(sides[0], t) for t in tables}))
        report.outcomes += [Outcome(sql, "SKIPPED", f"statement {k + 1} of the block") for k in range(done + 1, len(block))]
    return report
