"""What a layout does to the guarantees of a schema: SAFE, CHANGED or BROKEN.

Each rule is a function registered for one kind of guarantee; ``verdicts``
lists all guarantees of a schema with the verdict under given layouts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import Layout, Schema, junctions, relationships
from .sqlfront import Block, Select

SAFE, CHANGED, BROKEN = "SAFE", "CHANGED", "BROKEN"
RULES: dict[str, tuple] = {}
# Types whose stored form differs from the declared one.
LOSSY = frozenset(["CHAR", "DATE", "TIMESTAMPTZ", "TIME", "INTERVAL"])


@dataclass(frozen=True)
class Verdict:
    node: str
    rule: str
    outcome: str
    verdict: str


def rule(name: str, **outcomes: str):
    """Registers a rule: its function returns one of the outcomes, each with its verdict."""

    def register(f):
        RULES[name] = (f, outcomes)
        return f

    return register


def worst(verdicts) -> str:
    order = (SAFE, CHANGED, BROKEN)
    return max(verdicts, key=order.index, default=SAFE)


def _embedded(x: Layout, rel) -> bool:
    """Whether a relationship is the one that nests the child's rows; a folded junction only holds references."""
    return x.kind in ("object", "array") and x.rel is not None and x.rel.id == rel.id


def _repeats(table: str, layouts: dict[str, Layout]) -> bool:
    """Whether one document may hold several rows of a table: no index over documents then keeps its keys."""
    x = layouts[table]
    while x.kind == "object":
        x = layouts[x.host]
    return x.kind != "root"


@rule("EQ-REF-INTEGRITY", EMBEDDED=SAFE, REFERENCED=CHANGED)
def _integrity(rel, layouts, schema):
    return "EMBEDDED" if _embedded(layouts[rel.child], rel) else "REFERENCED"


@rule("EQ-CASCADE-DEL", EMBEDDED=SAFE, REFERENCED=BROKEN, CHAIN=BROKEN)
def _cascade(rel, layouts, schema):
    if not _embedded(layouts[rel.child], rel):
        return "REFERENCED"
    below, seen = [rel.child], set()
    while below:
        t = below.pop()
        seen.add(t)
        for r in relationships(schema):
            if r.parent == t and r.fk.on_delete == "CASCADE" and r.child not in seen:
                if not _embedded(layouts[r.child], r):
                    return "CHAIN"
                below.append(r.child)
    return "EMBEDDED"


@rule("EQ-CASCADE-UPD", EMBEDDED=SAFE, IMMUTABLE_KEY=CHANGED, MUTABLE_KEY=BROKEN)
def _cascade_update(rel, layouts, schema):
    if _embedded(layouts[rel.child], rel):
        return "EMBEDDED"
    return "IMMUTABLE_KEY" if tuple(rel.fk.ref_columns) == schema.tables[rel.parent].primary_key and len(rel.fk.ref_columns) == 1 else "MUTABLE_KEY"


@rule("EQ-SET-NULL", EMBEDDED=CHANGED, REFERENCED=BROKEN)
def _set_null(rel, layouts, schema):
    return _integrity(rel, layouts, schema)


@rule("EQ-SET-DEFAULT", EMBEDDED=CHANGED, REFERENCED=BROKEN)
def _set_default(rel, layouts, schema):
    return _integrity(rel, layouts, schema)


@rule("EQ-RESTRICT", EMBEDDED=CHANGED, REFERENCED=CHANGED)
def _restrict(rel, layouts, schema):
    return _integrity(rel, layouts, schema)


@rule("EQ-ENTITY-UNIQ", PK_SINGLE=SAFE, PK_COMPOSITE=SAFE, PK_FOLDED=CHANGED, PK_EMBEDDED=CHANGED)
def _entity(table, layouts, schema):
    kind = layouts[table.name].kind
    if kind.startswith("ref_"):
        return "PK_FOLDED"
    if _repeats(table.name, layouts):
        return "PK_EMBEDDED"
    return "PK_SINGLE" if len(table.primary_key) == 1 else "PK_COMPOSITE"


@rule("EQ-VALUE-UNIQ", EMBEDDED=CHANGED, PARTIAL_UNTRANSLATABLE=CHANGED, NULLABLE=CHANGED, PARTIAL_OK=SAFE, UNIQUE_INDEX=SAFE)
def _value_unique(node, layouts, schema):
    table, unique = node
    if _repeats(table.name, layouts):
        return "EMBEDDED"
    if unique.where is not None:
        return "PARTIAL_OK" if simple(unique.where) else "PARTIAL_UNTRANSLATABLE"
    return "NULLABLE" if any(table.column(c).nullable for c in unique.columns) else "UNIQUE_INDEX"


@rule("EQ-CROSS-UNIQ", OWN_COLLECTION=SAFE, EMBEDDED=CHANGED, SPLIT=BROKEN)
def _cross_unique(node, layouts, schema):
    kind = layouts[node.table].kind
    return "OWN_COLLECTION" if kind == "root" else "SPLIT" if kind.startswith("ref_") else "EMBEDDED"


@rule("EQ-NOT-NULL", VALIDATOR=SAFE)
def _not_null(node, layouts, schema):
    return "VALIDATOR"


@rule("EQ-CHECK", SAFE_JSONSCHEMA=SAFE, SAFE_EXPR=SAFE, UNTRANSLATABLE=CHANGED)
def _check(node, layouts, schema):
    table, check = node
    if not translatable(check.expr):
        return "UNTRANSLATABLE"
    return "SAFE_JSONSCHEMA" if simple(check.expr) else "SAFE_EXPR"


@rule("EQ-TYPE", EXACT=SAFE, LOSSY=CHANGED)
def _type(node, layouts, schema):
    c = node
    return "LOSSY" if c.type in LOSSY or c.type == "DECIMAL" and len(c.size) == 2 and c.size[1] > 0 else "EXACT"


@rule("EQ-DEFAULT", CONSTANT=CHANGED, NOW=CHANGED, EXPRESSION=CHANGED)
def _default(node, layouts, schema):
    d = node.default
    return "CONSTANT" if d[0] == "lit" else "NOW" if d[0] == "call" and d[1] in ("now", "current_timestamp", "current_date", "clock_timestamp") else "EXPRESSION"


@rule("EQ-AUTOINC", OBJECTID=CHANGED, COUNTER=CHANGED)
def _autoinc(node, layouts, schema):
    return "COUNTER" if node[1] else "OBJECTID"


@rule("EQ-ENUM", ENUM_LIST=SAFE)
def _enum(node, layouts, schema):
    return "ENUM_LIST"


@rule("EQ-ATOMIC", SINGLE_DOCUMENT=SAFE, TRANSACTION=CHANGED, NO_TRANSACTION=BROKEN)
def _atomic(node, layouts, schema):
    tables, transactions = node
    roots = set()
    for t in tables:
        while layouts[t].kind != "root":
            t = layouts[t].host
        roots.add(t)
    return "SINGLE_DOCUMENT" if len(roots) == 1 else "TRANSACTION" if transactions else "NO_TRANSACTION"


@rule("EQ-JOIN", INNER_EMBEDDED=SAFE, INNER_REFERENCED=SAFE, LEFT_CLEAN=SAFE, LEFT_NULLS=CHANGED)
def _join(node, layouts, schema):
    kind, table, scope, on, shown = node
    if kind == "left":
        return "LEFT_NULLS" if shown else "LEFT_CLEAN"
    # An embedded edge is followed if the join is between a table and its host, on the columns of their foreign key.
    for child, host in [(table, u) for u in scope] + [(u, table) for u in scope]:
        x = layouts[child]
        if x.kind != "root" and x.host == host and x.rel is not None and all(repr(c) in on for c in (*x.rel.fk.columns, *x.rel.fk.ref_columns)):
            return "INNER_EMBEDDED"
    return "INNER_REFERENCED"


@rule("EQ-AGG", AGG_SAFE=SAFE, AGG_CHANGED=CHANGED)
def _agg(node, layouts, schema):
    grouped, calls = node
    differs = [exact if name == "avg" else name == "sum" and (not grouped or left_joined) for name, exact, left_joined in calls]
    return "AGG_CHANGED" if any(differs) else "AGG_SAFE"


# What of this library does the work that a layout no longer does by itself.
MITIGATIONS = {
    "EQ-REF-INTEGRITY": "operators.dml.check_new", "EQ-CASCADE-DEL": "operators.dml.delete_rows", "EQ-SET-NULL": "operators.dml.delete_rows", "EQ-SET-DEFAULT": "operators.dml.delete_rows",
    "EQ-RESTRICT": "operators.dml.delete_rows", "EQ-CASCADE-UPD": "operators.dml.update_key", "EQ-ENTITY-UNIQ": "operators.dml.check_new", "EQ-VALUE-UNIQ": "operators.dml.check_new",
    "EQ-CROSS-UNIQ": "operators.dml.check_new", "EQ-CHECK": "operators.checks.audit", "EQ-DEFAULT": "operators.dml.insert", "EQ-AUTOINC": "operators.dml.insert", "EQ-ATOMIC": "operators.dml.execute",
}


def mitigations(found: list[Verdict]) -> dict[str, list[str]]:
    """function: the nodes that are not SAFE and whose guarantee it keeps."""
    out: dict[str, list[str]] = {}
    for v in found:
        if v.verdict != SAFE and v.rule in MITIGATIONS:
            out.setdefault(MITIGATIONS[v.rule], []).append(v.node)
    return out


def simple(x) -> bool:
    """Whether a predicate only compares one column with literals."""
    if x[0] == "op" and x[1] in ("and",):
        return simple(x[2]) and simple(x[3])
    if x[0] == "op":
        return x[1] in ("=", "<", "<=", ">", ">=") and {x[2][0], x[3][0]} <= {"col", "lit", "neg"} and x[2][0] != x[3][0]
    return x[0] in ("in", "between", "null", "col", "like")


def translatable(x) -> bool:
    if isinstance(x, (tuple, list)):
        if x and x[0] == "call" and x[1] not in ("length", "char_length"):
            return False
        return all(translatable(y) for y in x if isinstance(y, (tuple, list)))
    return True


_AGGREGATES = ("count", "sum", "avg", "min", "max")
#: Types whose values are exact.
_EXACT = ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL")


def _nodes(x, kinds: tuple[str, ...], below: bool = True) -> list[tuple]:
    """The nodes of an expression of these kinds, outermost first; those within aggregates only if ``below``."""
    if not isinstance(x, (tuple, list)) or not x:
        return []
    out = [tuple(x)] if x[0] in kinds else []
    if not below and x[0] == "call" and x[1] in _AGGREGATES:
        return out
    return out + [n for y in x for n in _nodes(y, kinds, below)]


def _owner(c: tuple, scope: dict, schema: Schema) -> str | None:
    """The alias that a column or star belongs to; None for a star of all."""
    if c[1] is not None or c[0] == "star":
        return c[1]
    return next((b for b, t in scope.items() if c[2] in schema.tables[t].names()), None)


def _shown(q: Select, scope: dict, schema: Schema) -> set[str]:
    """The aliases of which a query shows columns as they are; what is only aggregated is not shown."""
    out: set[str] = set()
    for x, _ in q.items:
        for c in _nodes(x, ("col", "star"), below=False):
            b = _owner(c, scope, schema)
            out |= set(scope) if c[0] == "star" and b is None else {b}
    return out


def _calls(q: Select, scope: dict, schema: Schema) -> list[tuple[str, bool, bool]]:
    """(aggregate, whether it takes a column of an exact type, whether that is of a left-joined table) of every aggregate of a query."""
    left = {a or t for kind, t, a, _ in q.joins if kind == "left"}
    out = []
    for x in [*[i for i, _ in q.items], q.having, *[o[0] for o in q.order]]:
        for c in _nodes(x, ("call",)):
            if c[1] not in _AGGREGATES:
                continue
            arg = c[2][0] if c[2] else ("star", None)
            b = _owner(arg, scope, schema) if arg[0] == "col" else None
            column = schema.tables[scope[b]].column(arg[2]) if b in scope else None
            out.append((c[1], column is not None and column.type in _EXACT, b in left))
    return out


def tables_of(q) -> list[str]:
    """The tables that a statement names."""
    return [q.source[0], *[j[1] for j in q.joins]] if isinstance(q, Select) and q.source else [q.table] if not isinstance(q, Select) else []


def _named(queries) -> list:
    """Parsed statements as (id, statement); pairs and blocks stay."""
    return [q if isinstance(q, (tuple, Block)) else (f"q{i + 1}", q) for i, q in enumerate(queries)]


def guarantees(schema: Schema, queries: list = (), transactions: bool = True, integer_ids: bool = True) -> list[tuple[str, str, object]]:
    """(node id, rule, subject) of every guarantee.  ``queries`` are parsed statements, or the items of a script: (id, statement) and blocks.

    Ids that would be given twice get a number."""
    out: list[tuple[str, str, object]] = []
    seen: dict[str, int] = {}

    def add(node: str, rule: str, subject) -> None:
        seen[node] = seen.get(node, 0) + 1
        out.append((node if seen[node] == 1 else f"{node}#{seen[node]}", rule, subject))

    on_delete = {"CASCADE": ("cascade_delete", "EQ-CASCADE-DEL"), "SET NULL": ("set_null", "EQ-SET-NULL"), "SET DEFAULT": ("set_default", "EQ-SET-DEFAULT"), "RESTRICT": ("restrict_delete", "EQ-RESTRICT"), "NO ACTION": ("restrict_delete", "EQ-RESTRICT")}
    for t in schema.tables.values():
        for c in t.columns:
            at = f"{t.name}.{c.name}"
            add(f"type:{at}", "EQ-TYPE", c)
            if not c.nullable:
                add(f"not_null:{at}", "EQ-NOT-NULL", c)
            if c.default is not None:
                add(f"default:{at}", "EQ-DEFAULT", c)
            if c.identity:
                add(f"auto_increment:{at}", "EQ-AUTOINC", (c, integer_ids))
            if c.type in schema.enums:
                add(f"enum:{at}", "EQ-ENUM", c)
        if t.primary_key:
            add(f"pk:{t.name}.{','.join(t.primary_key)}", "EQ-ENTITY-UNIQ", t)
        for u in t.uniques:
            add(f"unique:{t.name}.{','.join(u.columns)}", "EQ-VALUE-UNIQ", (t, u))
        for c in t.checks:
            add(f"check:{t.name}.{c.name or re.sub('[^0-9A-Za-z]+', '_', c.sql).strip('_')[:40]}", "EQ-CHECK", (t, c))
    for r in relationships(schema):
        if r.parent not in schema.tables:
            continue
        add(r.id, "EQ-REF-INTEGRITY", r)
        kind, name = on_delete[r.fk.on_delete]
        add(f"{kind}:{r.id.removeprefix('fk:')}", name, r)
        if r.fk.on_update == "CASCADE":
            add(f"cascade_update:{r.id.removeprefix('fk:')}", "EQ-CASCADE-UPD", r)
    for j in junctions(schema):
        add(f"cross_unique:{j.table}.{','.join(dict.fromkeys([*j.left.fk.columns, *j.right.fk.columns]))}", "EQ-CROSS-UNIQ", j)
    for item in _named(queries):
        if isinstance(item, Block):
            tables = {t for _, q in item.statements for t in tables_of(q) if t in schema.tables}
            if len(tables) > 1:
                add(f"txn:{item.id}", "EQ-ATOMIC", (tables, transactions))
        for i, q in item.statements if isinstance(item, Block) else [item]:
            if not isinstance(q, Select) or not q.source or any(t not in schema.tables for t in tables_of(q)):
                continue
            scope = {q.source[1] or q.source[0]: q.source[0]} | {a or t: t for _, t, a, _ in q.joins}
            shown = _shown(q, scope, schema)
            for k, (kind, t, a, on) in enumerate(q.joins):
                add(f"join:{i}#{k}", "EQ-JOIN", (kind, t, [u for b, u in scope.items() if b != (a or t)], repr(on), (a or t) in shown))
            calls = _calls(q, scope, schema)
            if calls or q.group:
                add(f"aggregate:{i}", "EQ-AGG", (bool(q.group), calls))
    return out


def verdicts(schema: Schema, layouts: dict[str, Layout], queries: list = (), transactions: bool = True, integer_ids: bool = True) -> list[Verdict]:
    out = []
    for node, name, subject in guarantees(schema, queries, transactions, integer_ids):
        f, outcomes = RULES[name]
        o = f(subject, layouts, schema)
        out.append(Verdict(node, name, o, outcomes[o]))
    return out
