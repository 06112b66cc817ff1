"""Nesting flat tables into documents and flattening them back.

A placement names, per relationship, ``EMBED`` (rows live in their parent) or
nothing (they keep their own table); junctions may be folded into arrays of the
other side's keys.  ``flatten`` of ``nest`` gives back every table, row for row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DocshapeError, Layout, Relationship, Schema, relationships


def build_layouts(schema: Schema, embed: list[str], fold: dict[str, str] | None = None, allow_nullable: bool = False) -> dict[str, Layout]:
    """The layout of every table: ``embed`` lists relationship ids, ``fold`` maps a junction to the parent that holds it.

    A child embedded through a nullable key would lose its rows without a parent, so that is refused unless allowed."""
    rels = {r.id: r for r in relationships(schema)}
    hosts: dict[str, Relationship] = {}
    for i in embed:
        r = rels.get(i)
        if r is None:
            raise DocshapeError("LAYOUT", f"no relationship {i}")
        if r.nullable and not allow_nullable:
            raise DocshapeError("LAYOUT", f"{i} is nullable: rows without a parent would be lost")
        hosts.setdefault(r.child, r)
    out: dict[str, Layout] = {}
    for t in schema.tables.values():
        chain, at = {t.name}, t.name
        while at in hosts and hosts[at].parent not in chain:
            at = hosts[at].parent
            chain.add(at)
        cyclic = at in hosts
        host = (fold or {}).get(t.name)
        if host:
            own = [r for r in rels.values() if r.child == t.name]
            mine = next(r for r in own if r.parent == host)
            rest = tuple(c for c in t.names() if c not in mine.fk.columns)
            scalar = len(rest) == 1
            out[t.name] = Layout(t.name, "ref_scalars" if scalar else "ref_docs", host, _name(schema, host, f"{rest[0]}s" if scalar else t.name), mine, rest)
        elif t.name in hosts and not cyclic:
            r = hosts[t.name]
            rest = tuple(c for c in t.names() if c not in r.fk.columns)
            out[t.name] = Layout(t.name, "object" if r.one else "array", r.parent, _name(schema, r.parent, t.name), r, rest)
        else:
            out[t.name] = Layout(t.name, "root", fields=tuple(t.names()))
    return out


def _name(schema: Schema, host: str, wanted: str) -> str:
    return f"{wanted}_docs" if wanted in schema.tables[host].names() else wanted


@dataclass
class Catalog:
    """Root tables as DataFrames of documents, and where every table's rows live in them."""

    schema: Schema
    layouts: dict[str, Layout]
    roots: dict[str, DataFrame] = field(default_factory=dict)

    def children(self, table: str) -> list[Layout]:
        return [x for x in self.layouts.values() if x.host == table]

    def with_root(self, table: str, df: DataFrame) -> Catalog:
        return Catalog(self.schema, self.layouts, self.roots | {table: df})


def _documents(schema: Schema, layouts: dict[str, Layout], flat: dict[str, DataFrame], table: str) -> DataFrame:
    """``table``'s rows with its embedded children: one aggregation and one left join for each child table."""
    df = flat[table].select(*schema.tables[table].names())
    for x in layouts.values():
        if x.host != table:
            continue
        child = _documents(schema, layouts, flat, x.table)
        fk, key = x.rel.fk.columns, x.rel.fk.ref_columns
        pk = [c for c in schema.tables[x.table].primary_key if c in x.fields]
        nested = [c for c in child.columns if c not in schema.tables[x.table].names()]
        names = [*pk, *[c for c in x.fields if c not in pk], *nested]
        if x.kind == "ref_scalars":
            rows = F.array_sort(F.collect_list(F.col(x.fields[0])))
        elif x.kind == "object":
            rows = F.min(F.struct(*names))
        else:
            rows = F.array_sort(F.collect_list(F.struct(*names)))
        ref = [f"_ref{i}" for i in range(len(fk))]
        grouped = child.groupBy(*[F.col(c).alias(r) for c, r in zip(fk, ref)]).agg(rows.alias(x.path))
        cond = [F.col(k) == F.col(r) for k, r in zip(key, ref)]
        df = df.join(grouped, cond, "left").drop(*ref)
    return df


def nest(schema: Schema, layouts: dict[str, Layout], flat: dict[str, DataFrame]) -> Catalog:
    roots = {t: _documents(schema, layouts, flat, t) for t, x in layouts.items() if x.kind == "root" and t in flat}
    return Catalog(schema, layouts, roots)


def nested_fields(cat: Catalog, table: str) -> list[str]:
    return [x.path for x in cat.children(table)]


def rows_of(cat: Catalog, table: str, columns: list[str] | None = None, nested: list[str] | None = None) -> DataFrame:
    """The table's rows out of their documents: its ``columns`` and the ``nested`` fields of its own children.

    Keys that nesting made implicit come back from the host.  Only the named element fields are read."""
    names = cat.schema.tables[table].names()
    columns = [c for c in names if columns is None or c in columns]
    nested = nested_fields(cat, table) if nested is None else nested
    x = cat.layouts[table]
    if x.kind == "root":
        return cat.roots[table].select(*columns, *nested)
    key = dict(zip(x.rel.fk.columns, x.rel.fk.ref_columns))
    host = rows_of(cat, x.host, list(key.values()), [x.path])
    keys = [F.col(key[c]).alias(c) for c in key if c in columns]
    own = [c for c in columns if c not in key]
    if x.kind == "object":
        return host.where(F.col(x.path).isNotNull()).select(*keys, *[F.col(x.path)[c].alias(c) for c in [*own, *nested]]).select(*columns, *nested)
    if x.kind == "ref_scalars":
        return host.select(*keys, F.explode(x.path).alias(x.fields[0])).select(*columns)
    return unnest(host, x.path, keys, [*own, *nested], outer=False).select(*columns, *nested)


def unnest(df: DataFrame, path: str, keep: list, fields: list[str], outer: bool) -> DataFrame:
    """A row for each element of an array of structs, with the named fields only: several are zipped, so that the
    scan reads no others."""
    explode = F.explode_outer if outer else F.explode
    if not fields:
        return df.select(*keep, explode(path).alias("_e")).drop("_e")
    if len(fields) == 1:
        return df.select(*keep, explode(F.col(path)[fields[0]]).alias(fields[0]))
    zipped = F.arrays_zip(*[F.col(path)[f].alias(f) for f in fields])
    out = df.select(*keep, explode(zipped).alias("_e"))
    base = [c for c in out.columns if c != "_e"]
    return out.select(*[F.col(f"`{c}`") for c in base], *[F.col("_e")[f].alias(f) for f in fields])


def flatten(cat: Catalog, table: str) -> DataFrame:
    """The flat table, all declared columns in their order."""
    return rows_of(cat, table, nested=[])


def flatten_all(cat: Catalog) -> dict[str, DataFrame]:
    return {t: flatten(cat, t) for t, x in cat.layouts.items() if _root(cat, t) in cat.roots}


def _root(cat: Catalog, table: str) -> str:
    while cat.layouts[table].kind != "root":
        table = cat.layouts[table].host
    return table
