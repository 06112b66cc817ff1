"""Seeded rows for a schema: every value is a hash of seed, table, row number and column.

Row numbers make keys unique, parents are chosen by hash (or one to one), so
any number of rows is generated without looking at others.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Column, Schema, Table
from ..plans.query import spark_type

NULLS = 20  # per cent of nullable cells
ROWS = 50


def insertion_order(schema: Schema) -> list[str]:
    """Parents before children; where tables refer to each other, nullable keys do not count."""
    done: list[str] = []
    left = dict(schema.tables)
    for strict in (True, False, None):
        while True:
            free = [t for t in left.values() if all(fk.ref_table in done or fk.ref_table == t.name or fk.ref_table not in left or (strict is False and all(t.column(c).nullable for c in fk.columns)) or strict is None for fk in t.foreign_keys)]
            if not free:
                break
            done.append(free[0].name)
            del left[free[0].name]
            if strict is not True:
                break
        if not left:
            break
    return done + list(left)


def bounds(table: Table) -> dict[str, tuple]:
    """Per column what its simple CHECKs allow: ("in", values) or ("range", low, high)."""
    out: dict[str, tuple] = {}

    def note(x) -> None:
        if x[0] == "op" and x[1] == "and":
            note(x[2])
            note(x[3])
        elif x[0] == "in" and x[1][0] == "col" and not x[3]:
            out[x[1][2]] = ("in", [i[1] for i in x[2]])
        elif x[0] == "between" and x[1][0] == "col" and x[2][0] == x[3][0] == "lit":
            out[x[1][2]] = ("range", float(x[2][1]), float(x[3][1]))
        elif x[0] == "op" and x[2][0] == "col" and x[3][0] == "lit" and x[3][2] in ("int", "dec"):
            _, low, high = out.get(x[2][2], ("range", None, None)) if out.get(x[2][2], ("range",))[0] == "range" else ("range", None, None)
            v = float(x[3][1])
            if x[1] in (">", ">="):
                low = v + (x[1] == ">")
            elif x[1] in ("<", "<="):
                high = v - (x[1] == "<")
            out[x[2][2]] = ("range", low, high)

    for c in table.checks:
        note(c.expr)
    return out


def _value(c: Column, schema: Schema, bound: tuple | None, h: C, unique: bool, number: C) -> C:
    below = lambda n: F.pmod(h, F.lit(n))
    kind = spark_type(c.type, c.size, False)
    if c.type in schema.enums:
        values = schema.enums[c.type]
        return F.element_at(F.array(*[F.lit(v) for v in values]), (below(len(values)) + 1).cast("int"))
    if bound and bound[0] == "in":
        return F.element_at(F.array(*[F.lit(v) for v in bound[1]]), (below(len(bound[1])) + 1).cast("int")).cast(kind)
    if c.type in ("SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE"):
        if unique:
            return (number + 1).cast(kind)
        low = bound[1] if bound and bound[1] is not None else 0.0
        high = bound[2] if bound and bound[2] is not None else low + 1000.0
        x = F.lit(low) + below(1_000_000) / 1_000_000.0 * F.lit(high - low)
        return (F.floor(x) if c.type in ("SMALLINT", "INTEGER", "BIGINT") and high - low >= 1 else x).cast(kind)
    if c.type == "BOOLEAN":
        return below(2) == 0
    if c.type in ("DATE", "TIMESTAMP", "TIMESTAMPTZ"):
        return F.timestamp_seconds(F.lit(1_700_000_000) + below(31_536_000)).cast(kind)
    if c.type == "INTERVAL":
        return F.make_dt_interval(secs=below(86_400).cast("decimal(18,6)"))
    text = F.concat(F.lit(f"{c.name}_"), number.cast("string") if unique else below(1000).cast("string"))
    if c.type == "UUID":
        x = F.md5(F.concat_ws(":", h.cast("string"), number.cast("string")))
        return F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    if c.type in ("JSON", "JSONB"):
        return F.concat(F.lit('{"k": '), below(100).cast("string"), F.lit("}"))
    if c.type == "TIME":
        return F.date_format(F.timestamp_seconds(below(86_400)), "HH:mm:ss")
    if c.type == "BYTEA":
        return text.cast("binary")
    if c.size:
        return F.right(text, F.lit(c.size[0]))
    return text


def generate(spark: SparkSession, schema: Schema, seed: int = 1, rows: int | dict[str, int] = ROWS) -> dict[str, DataFrame]:
    """A DataFrame of the declared columns for each table; foreign keys hold, keys are unique, simple CHECKs and enums hold."""
    out: dict[str, DataFrame] = {}
    many = lambda t: rows if isinstance(rows, int) else rows.get(t, ROWS)

    def key_value(table: str, column: str, number: C) -> C:
        """The value of a key column in a given row: the same rule for the row itself and for those that refer to it."""
        t = schema.tables[table]
        for fk in t.foreign_keys:
            if column in fk.columns and fk.ref_table != table:
                return key_value(fk.ref_table, fk.ref_columns[fk.columns.index(column)], parent_row(t, fk, number))
        h = F.xxhash64(F.lit(seed), F.lit(f"{table}.{column}"), number)
        return _value(t.column(column), schema, None, h, True, number)

    def parent_row(t: Table, fk, number: C) -> C:
        n = many(fk.ref_table)
        single = any(k <= frozenset(fk.columns) for k in t.key_sets())
        own = [x for x in t.foreign_keys if any(frozenset(x.columns) <= k for k in t.key_sets())]
        if single:
            return F.pmod(number, F.lit(n))
        if fk in own and len(own) > 1:  # parts of one composite key: row numbers are spread over all pairs
            return F.pmod(number, F.lit(n)) if own.index(fk) == 0 else F.pmod(F.floor(number / many(own[0].ref_table)).cast("long") + number, F.lit(n))
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(f"{t.name}->{','.join(fk.columns)}"), number), F.lit(n))

    for name in insertion_order(schema):
        t, allowed = schema.tables[name], bounds(schema.tables[name])
        limit = min([many(name)] + [many(fk.ref_table) for fk in t.foreign_keys if any(k <= frozenset(fk.columns) for k in t.key_sets())])
        number = F.col("id")
        unique = {c for k in t.key_sets() for c in k} | {c for u in t.uniques for c in u.columns}
        cells = []
        for c in t.columns:
            h = F.xxhash64(F.lit(seed), F.lit(f"{name}.{c.name}"), number)
            fk = next((x for x in t.foreign_keys if c.name in x.columns), None)
            if fk:
                v = key_value(fk.ref_table, fk.ref_columns[fk.columns.index(c.name)], parent_row(t, fk, number))
            else:
                v = _value(c, schema, allowed.get(c.name), h, c.name in unique, number)
            v = v.cast(spark_type(c.type, c.size, False))
            v = F.array(v) if c.array else v
            if c.nullable and c.name not in t.primary_key:
                v = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(f"null:{name}.{c.name}"), number), F.lit(100)) >= NULLS, v)
            cells.append(v.alias(c.name))
        out[name] = spark.range(limit).select(*cells)
    return out
