"""Deliberate violations: what a layout does with a write that a foreign key would act on or refuse.

Each relationship is probed by itself: the flat side enforces this one key and no other, the nested side applies the
plain write, and the tables of both ends are compared.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import DocshapeError, Relationship, Schema, relationships
from .operators.diff import same_multiset
from .operators.dml import delete, delete_rows, insert, update, update_key
from .operators.reshape import Catalog, flatten
from .plans.sqlfront import Delete, Insert, Update

KINDS = ("delete", "orphan", "key_update")


@dataclass(frozen=True)
class Probe:
    relationship: str
    kind: str
    outcome: str  # HELD, BROKEN, SKIPPED
    detail: str = ""


def _literal(v) -> tuple:
    kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "dec" if isinstance(v, float) else "text"
    return ("lit", v, kind)


def _equal(row: dict):
    out = None
    for c, v in row.items():
        x = ("op", "=", ("col", None, c), _literal(v))
        out = x if out is None else ("op", "and", out, x)
    return out


def _unused(rows: DataFrame, column: str):
    """A value beyond all of the column's: the next number, or a longer text."""
    top = rows.agg(F.max(column)).first()[0]
    return 1 if top is None else top + 1 if isinstance(top, (int, float)) else f"{top}~"


def _alone(schema: Schema, r: Relationship) -> Schema:
    """The schema with no foreign key but this one."""
    keys = {r.child: (r.fk,)}
    return Schema({n: replace(t, foreign_keys=keys.get(n, ())) for n, t in schema.tables.items()}, schema.enums)


def _compared(r: Relationship, kind: str, flat, nested) -> Probe:
    """Runs both sides; both refusing is as good as both agreeing."""
    try:
        want, refused = flat(), ""
    except DocshapeError as e:
        want, refused = None, str(e)
    try:
        got = nested()
    except DocshapeError as e:
        return Probe(r.id, kind, "HELD", f"both refuse: {e}") if refused else Probe(r.id, kind, "BROKEN", f"only the layout refuses: {e}")
    if refused:
        return Probe(r.id, kind, "BROKEN", f"the layout takes what the key refuses: {refused}")
    wrong = [t for t in dict.fromkeys([r.parent, r.child]) if not same_multiset(want[t], flatten(got, t).select(*want[t].columns))]
    return Probe(r.id, kind, "BROKEN", f"{', '.join(wrong)} differ") if wrong else Probe(r.id, kind, "HELD")


def probe(cat: Catalog, r: Relationship) -> list[Probe]:
    """The three probes of one relationship over the catalog's rows; the catalog is left as it is."""
    tables = {t: flatten(cat, t) for t in dict.fromkeys([r.parent, r.child])}
    parent, child, fk = tables[r.parent], tables[r.child], r.fk
    keys = parent.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(fk.ref_columns)])
    row = child.join(keys, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fk.columns)], "left_semi").orderBy(*fk.columns).first()
    if row is None:
        return [Probe(r.id, k, "SKIPPED", "no child has a parent") for k in KINDS]
    used, alone = row.asDict(), _alone(cat.schema, r)
    at = {k: used[c] for c, k in zip(fk.columns, fk.ref_columns)}
    hit = F.lit(True)
    for k, v in at.items():
        hit = hit & (F.col(k) == F.lit(v))
    out = [_compared(r, "delete", lambda: delete_rows(alone, tables, r.parent, hit), lambda: delete(cat, Delete(table=r.parent, where=_equal(at))))]

    t = cat.schema.tables[r.child]
    fresh = {c: _unused(child, c) for c in t.primary_key if c not in fk.columns}
    lost = used | fresh | {c: _unused(parent, k) for c, k in zip(fk.columns, fk.ref_columns)}
    given = {c: v for c, v in lost.items() if v is not None}
    cells = [_literal(v) if isinstance(v, (bool, int, float, str)) else ("lit", str(v), "text") for v in given.values()]

    def refuse():
        raise DocshapeError("INTEGRITY", f"no {r.parent} row for a new {r.child} row")

    out.append(_compared(r, "orphan", refuse, lambda: insert(cat, Insert(table=r.child, columns=list(given), rows=[cells]), checked=False)))

    k = fk.ref_columns[0]
    new = _unused(parent, k)
    out.append(_compared(r, "key_update", lambda: update_key(alone, tables, r.parent, k, F.lit(new), hit), lambda: update(cat, Update(table=r.parent, sets=[(k, _literal(new))], where=_equal(at)))))
    return out


def run_probes(cat: Catalog) -> list[Probe]:
    """All probes of the relationships whose two tables the catalog holds."""
    return [p for r in relationships(cat.schema) if r.parent in cat.layouts and r.child in cat.layouts for p in probe(cat, r)]
