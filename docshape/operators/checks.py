"""Schema guarantees evaluated on data: each check counts its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Schema, Table
from ..plans.query import to_column


def _resolve(df: DataFrame):
    kinds = {f.name: f.dataType for f in df.schema}
    return lambda n: (F.col(n[2]), kinds[n[2]]) if n[0] == "col" else None


def duplicate_keys(df: DataFrame, columns: list[str], nullable: bool = False, where=None) -> DataFrame:
    """Keys that several rows share; rows with a null key column count only if not ``nullable``."""
    if where is not None:
        df = df.where(F.coalesce(to_column(where, _resolve(df)), F.lit(False)))
    if nullable:
        df = df.dropna(subset=list(columns))
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    p = parent.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return child.dropna(subset=list(columns)).join(p, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(columns)], "left_anti")


def check_violations(df: DataFrame, expr) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes."""
    return df.where(~F.coalesce(to_column(expr, _resolve(df)), F.lit(True)))


def element_violations(docs: DataFrame, path: str, predicate) -> DataFrame:
    """Documents with an array element for which ``predicate`` is false; no array passes."""
    return docs.where(~F.coalesce(F.forall(path, lambda e: F.coalesce(predicate(e), F.lit(True))), F.lit(True)))


def repeated_elements(docs: DataFrame, path: str) -> DataFrame:
    """Documents whose array holds a value twice."""
    return docs.where(F.size(path) > F.size(F.array_distinct(path)))


def row_checks(table: Table, schema: Schema) -> list[tuple[str, object]]:
    """(name, Column that is true for a violation) of all guarantees that one row can break."""
    out = []
    for c in table.columns:
        if not c.nullable:
            out.append((f"not_null:{c.name}", F.col(c.name).isNull()))
        if c.size and c.type in ("VARCHAR", "CHAR"):
            out.append((f"length:{c.name}", F.char_length(c.name) > c.size[0]))
        if c.type in schema.enums:
            out.append((f"enum:{c.name}", ~F.col(c.name).isin(*schema.enums[c.type])))
    return out


def audit(schema: Schema, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, guarantee, violations) of every guarantee of every table: one pass per table for the row checks, one
    aggregation per key and one anti-join per foreign key."""
    parts = []
    for name, df in tables.items():
        t = schema.tables[name]
        rows = row_checks(t, schema) + [(f"check:{c.name or c.sql}", ~F.coalesce(to_column(c.expr, _resolve(df)), F.lit(True))) for c in t.checks]
        if rows:
            counts = df.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(f"_{i}") for i, (_, v) in enumerate(rows)])
            pairs = F.array(*[F.struct(F.lit(n).alias("guarantee"), F.col(f"_{i}").alias("violations")) for i, (n, _) in enumerate(rows)])
            parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(pairs)))
        keys = ([("primary_key", t.primary_key, False, None)] if t.primary_key else []) + [("unique", u.columns, True, u.where) for u in t.uniques]
        for kind, cols, nullable, where in keys:
            parts.append(_counted(duplicate_keys(df, list(cols), nullable, where), name, f"{kind}:{','.join(cols)}"))
        for fk in t.foreign_keys:
            if fk.ref_table in tables:
                parts.append(_counted(orphans(df, list(fk.columns), tables[fk.ref_table], list(fk.ref_columns)), name, f"foreign_key:{','.join(fk.columns)}"))
    return reduce(DataFrame.unionByName, parts)


def _counted(df: DataFrame, table: str, guarantee: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(guarantee).alias("guarantee"), "violations")
