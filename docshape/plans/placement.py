"""Embed or reference: features, score and a global plan, on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..model import Relationship, Schema, junctions, relationships

# The weights of the cost model.
THRESHOLD = 0.5
MAX_PARENT_BYTES = 4 * 1024 * 1024
SAFETY = 2
MAX_CHILDREN = 1000
SMALL_CHILDREN = 50
MAX_DEPTH = 3
TOGETHER, SHAPE, GUARANTEES, INDEPENDENT, WRITES = 0.30, 0.20, 0.20, -0.20, -0.10
ONE_TO_ONE, FEW, OTHER = 1.0, 0.6, 0.0
WRITE_NORM = {"low": 0.0, "med": 0.5, "high": 1.0}
DEFAULTS = {"independent": 0.3, "together": 0.5, "writes": "med", "one": 1, "many": 20}
RAW_MIN, RAW_MAX = -0.3, 0.7
# Estimated sizes of stored values.
TYPE_BYTES = {
    "SMALLINT": 4, "INTEGER": 4, "BIGINT": 8, "DECIMAL": 16, "FLOAT": 8, "DOUBLE": 8, "BOOLEAN": 1, "TEXT": 100, "VARCHAR": 50, "CHAR": 16, "DATE": 8, "TIMESTAMP": 8, "TIMESTAMPTZ": 8, "TIME": 16,
    "UUID": 16, "JSON": 200, "JSONB": 200, "BYTEA": 100, "INTERVAL": 20,
}
ENUM_BYTES, FIELD_BYTES, DOC_BYTES, ARRAY_FACTOR, MAX_TEXT = 10, 7, 20, 5, 200


@dataclass
class Features:
    rel: Relationship
    together: float
    independent: float
    writes: str
    children: int
    child_bytes: int
    parent_bytes: int
    guarantees: int


@dataclass
class Decision:
    id: str
    decision: str  # EMBED, REFERENCE, REF_ARRAY
    score: float
    host: str = ""
    reason: str = ""
    factors: dict = field(default_factory=dict)


def row_bytes(schema: Schema, table: str) -> int:
    total = DOC_BYTES
    for c in schema.tables[table].columns:
        n = TYPE_BYTES.get(c.type, ENUM_BYTES)
        if c.type in ("VARCHAR", "CHAR") and c.size:
            n = min(c.size[0], MAX_TEXT)
        total += len(c.name) + FIELD_BYTES + (ARRAY_FACTOR * n if c.array else n)
    return total


def workload(schema: Schema, queries: list) -> dict[str, dict]:
    """Per relationship, from parsed statements: the share of the child's SELECTs that read the parent too, the share that read
    it alone, and how often it is written."""
    from .sqlfront import Select

    reads, writes = [], []
    for q in queries:
        if isinstance(q, Select):
            reads.append({q.source[0], *[j[1] for j in q.joins]})
        else:
            writes.append(q.table)
    out = {}
    for r in relationships(schema):
        touching = [x for x in reads if r.child in x]
        got: dict = {}
        if touching:
            got["together"] = sum(r.parent in x for x in touching) / len(touching)
            got["independent"] = sum(r.parent not in x for x in touching) / len(touching)
        if reads or writes:
            n = writes.count(r.child)
            got["writes"] = "low" if n == 0 else "med" if n <= 2 else "high"
        out[r.id] = got
    return out


def features(schema: Schema, queries: list = (), hints: dict | None = None, counts: dict[str, int] | None = None, transactions: list[set[str]] = ()) -> list[Features]:
    """A hint beats a measurement, which beats a default.  ``counts`` are measured rows per table, ``hints`` by relationship id."""
    measured, out = workload(schema, list(queries)), []
    for r in relationships(schema):
        h, m = (hints or {}).get(r.id, {}), measured[r.id]
        pick = lambda k: h.get(k, m.get(k, DEFAULTS[k]))
        seeded = max(1, round(counts[r.child] / counts[r.parent])) if counts and counts.get(r.child) and counts.get(r.parent) else None
        children = h.get("children", seeded if seeded is not None else DEFAULTS["one" if r.one else "many"])
        g = int(r.fk.on_delete in ("CASCADE", "SET NULL", "SET DEFAULT")) + sum(r.child in t and r.parent in t for t in transactions)
        out.append(Features(r, pick("together"), pick("independent"), pick("writes"), int(children), row_bytes(schema, r.child), row_bytes(schema, r.parent), g))
    return out


def projected_bytes(f: Features) -> int:
    return f.parent_bytes + f.children * f.child_bytes * SAFETY


def score(f: Features) -> Decision:
    shape = ONE_TO_ONE if f.rel.one else FEW if f.children <= SMALL_CHILDREN else OTHER
    if f.rel.self_ref:
        shape = OTHER
    parts = {
        "together": TOGETHER * f.together, "shape": SHAPE * shape, "guarantees": GUARANTEES * min(f.guarantees, 2) / 2, "independent": INDEPENDENT * f.independent, "writes": WRITES * WRITE_NORM[f.writes],
    }
    s = round(min(1.0, max(0.0, (sum(parts.values()) - RAW_MIN) / (RAW_MAX - RAW_MIN))), 4)
    hard = ""
    if f.rel.self_ref:
        hard = "a table is not nested in itself"
    elif f.children > MAX_CHILDREN:
        hard = "too many children"
    elif projected_bytes(f) > MAX_PARENT_BYTES:
        hard = "the document would be too large"
    decision = "REFERENCE" if hard or s < THRESHOLD else "EMBED"
    return Decision(f.rel.id, decision, s, f.rel.parent if decision == "EMBED" else "", hard or f"score {s:.2f}", parts)


def plan(schema: Schema, feats: list[Features], overrides: dict[str, str] | None = None) -> dict[str, Decision]:
    """The decision of every relationship and junction: overrides, one parent per child (forced, then score, then id), no cycles
    (the weakest edge goes), depth, size, then junctions fold into the parent that would embed them best."""
    overrides = overrides or {}
    by = {f.rel.id: f for f in feats}
    out = {f.rel.id: score(f) for f in feats}
    for i, d in overrides.items():
        if i in out and not by[i].rel.self_ref:
            out[i].decision, out[i].host, out[i].reason = d, by[i].rel.parent if d == "EMBED" else "", "override"
    bridges = {j.table: j for j in junctions(schema)}
    embedding = lambda: {i for i, d in out.items() if d.decision == "EMBED"}

    def refer(i: str, why: str) -> None:
        out[i].decision, out[i].host, out[i].reason = "REFERENCE", "", why

    best_of: dict[str, str] = {}
    for child in schema.tables:
        mine = sorted((i for i in embedding() if by[i].rel.child == child), key=lambda i: (i not in overrides, -out[i].score, i))
        if mine:
            best_of[child] = mine[0]
        for i in mine[1:]:
            refer(i, "the child has another parent")

    def host_chain(child: str) -> list[str]:
        """Embedding edges from a table up to its root, or around a cycle."""
        ids, seen = [], {child}
        up = {by[i].rel.child: i for i in embedding()}
        while child in up:
            ids.append(up[child])
            child = by[up[child]].rel.parent
            if child in seen:
                break
            seen.add(child)
        return ids

    for child in list(schema.tables):
        ids = host_chain(child)
        while ids and by[ids[-1]].rel.parent in {by[i].rel.child for i in ids}:
            refer(min(ids, key=lambda i: (out[i].score, i)), "a cycle of nesting")
            ids = host_chain(child)
    for child in list(schema.tables):
        while len(host_chain(child)) > MAX_DEPTH:
            refer(host_chain(child)[0], "nested too deep")

    def nested_bytes(table: str) -> int:
        return row_bytes(schema, table) + sum(by[i].children * SAFETY * nested_bytes(by[i].rel.child) for i in embedding() if by[i].rel.parent == table)

    for table in schema.tables:
        while nested_bytes(table) > MAX_PARENT_BYTES and any(by[i].rel.parent == table for i in embedding()):
            refer(max((i for i in embedding() if by[i].rel.parent == table), key=lambda i: by[i].children * nested_bytes(by[i].rel.child)), "the document would be too large")
    for j in bridges.values():
        key = f"m2n:{j.table}"
        edges = sorted((j.left.id, j.right.id), key=lambda i: (-out[i].score, i))
        forced = overrides.get(key)
        extra = bool(j.payload) or any(r.parent == j.table for r in relationships(schema))
        candidates = [i for i in edges if out[i].decision == "EMBED"]
        if forced == "REF_ARRAY" or (forced is None and not extra and candidates):
            i = (candidates or edges)[0]
            out[key] = Decision(key, "REF_ARRAY", out[i].score, by[i].rel.parent, "folded")
            for e in edges:
                refer(e, "the junction is folded")
        else:
            out[key] = Decision(key, "REFERENCE", 0.0, "", "a payload or no parent to fold into")
    return out
