"""Schema metadata: tables, keys, relationships, layouts, verdicts."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    default: object = None  # a parsed expression
    identity: bool = False
    size: tuple[int, ...] = ()
    array: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]
    where: object = None  # a parsed predicate of a partial index
    name: str = ""


@dataclass(frozen=True)
class Index:
    """A plain index: it guarantees nothing."""

    columns: tuple[str, ...]
    name: str = ""


@dataclass(frozen=True)
class Check:
    expr: object
    sql: str
    name: str = ""


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    indexes: tuple[Index, ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def key_sets(self) -> list[frozenset[str]]:
        return [frozenset(k) for k in [self.primary_key, *[u.columns for u in self.uniques if u.where is None]] if k]


@dataclass(frozen=True)
class Schema:
    tables: dict[str, Table] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # error, warning, info
    code: str
    message: str
    line: int = 0


@dataclass(frozen=True)
class Relationship:
    """A foreign key: id, child, parent, and whether a parent has at most one child (1:1)."""

    id: str
    child: str
    fk: ForeignKey
    one: bool
    nullable: bool

    @property
    def parent(self) -> str:
        return self.fk.ref_table

    @property
    def self_ref(self) -> bool:
        return self.child == self.parent


@dataclass(frozen=True)
class Junction:
    """A bridge of a many-to-many relationship, with at most two payload columns."""

    table: str
    left: Relationship
    right: Relationship
    payload: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    """Where a table's rows live: ``root``, ``object`` or ``array`` in a host, or folded as ``ref_scalars`` / ``ref_docs``."""

    table: str
    kind: str
    host: str = ""
    path: str = ""
    rel: Relationship | None = None
    fields: tuple[str, ...] = ()


class DocshapeError(ValueError):
    """A request that has no defined meaning; carries a code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def relationships(schema: Schema) -> list[Relationship]:
    out = []
    for t in schema.tables.values():
        for fk in t.foreign_keys:
            rel = f"fk:{t.name}.{','.join(fk.columns)}->{fk.ref_table}.{','.join(fk.ref_columns)}"
            one = any(k <= frozenset(fk.columns) for k in t.key_sets())
            nullable = any((c := t.column(n)) is None or c.nullable for n in fk.columns)
            out.append(Relationship(rel, t.name, fk, one, nullable))
    return out


def junctions(schema: Schema) -> list[Junction]:
    """Tables of two foreign keys to different tables whose columns together are a key, with at most two columns besides."""
    out = []
    for t in schema.tables.values():
        rels = [r for r in relationships(schema) if r.child == t.name]
        if len(rels) != 2 or rels[0].parent == rels[1].parent or t.name in (rels[0].parent, rels[1].parent):
            continue
        cols = frozenset(rels[0].fk.columns) | frozenset(rels[1].fk.columns)
        if not any(k == cols for k in t.key_sets()):
            continue
        surrogate = set(t.primary_key) - cols
        payload = tuple(n for n in t.names() if n not in cols and n not in surrogate)
        if len(payload) <= 2:
            out.append(Junction(t.name, rels[0], rels[1], payload))
    return out


def cycles(schema: Schema) -> list[list[str]]:
    """Simple cycles of foreign keys between different tables, each from its least table."""
    edges: dict[str, set[str]] = {}
    for r in relationships(schema):
        if not r.self_ref and r.parent in schema.tables:
            edges.setdefault(r.child, set()).add(r.parent)
    found: set[tuple[str, ...]] = set()

    def walk(path: list[str]) -> None:
        for n in sorted(edges.get(path[-1], ())):
            if n == path[0]:
                found.add(tuple(path))
            elif n > path[0] and n not in path:
                walk([*path, n])

    for t in sorted(edges):
        walk([t])
    return [list(c) for c in sorted(found)]
