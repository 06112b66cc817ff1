"""INSERT, UPDATE and DELETE as copies of the changed documents."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DocshapeError
from ..plans.query import spark_type, to_column
from ..plans.sqlfront import Delete, Insert, Update, parse_query
from .reshape import Catalog, _documents, _root, flatten


def _tables_of_root(cat: Catalog, root: str) -> list[str]:
    return [t for t in cat.layouts if _root(cat, t) == root]


def _rebuilt(cat: Catalog, table: str, rows: DataFrame) -> Catalog:
    """The catalog with ``table``'s flat rows replaced: its root's tables are flattened and nested again."""
    root = _root(cat, table)
    flat = {t: flatten(cat, t) for t in _tables_of_root(cat, root)} | {table: rows}
    return cat.with_root(root, _documents(cat.schema, cat.layouts, flat, root))


def _literal_rows(cat: Catalog, q: Insert, spark) -> DataFrame:
    """The VALUES rows in declared column order, defaults and identities filled."""
    t = cat.schema.tables[q.table]
    columns = q.columns or t.names()
    if set(columns) - set(t.names()):
        raise DocshapeError("SEM012", "no such column")
    kinds = {f.name: f.dataType for f in flatten(cat, q.table).schema}
    identity = [c.name for c in t.columns if c.identity]
    top = flatten(cat, q.table).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in identity]).first().asDict() if identity and not set(identity) <= set(columns) else {}
    out = None
    for i, row in enumerate(q.rows):
        if len(row) != len(columns):
            raise DocshapeError("NOT_TRANSLATED", "a row of another width")
        given = {c: v for c, v in zip(columns, row) if v is not None}
        cells = []
        for c in t.columns:
            x = given.get(c.name, c.default)
            v = F.lit(top[c.name] + i + 1) if x is None and c.name in top else F.lit(None) if x is None else to_column(x, lambda n: None)
            cells.append(v.cast(kinds.get(c.name, spark_type(c.type, c.size, c.array))).alias(c.name))
        one = spark.range(1).select(*cells)
        out = one if out is None else out.unionByName(one)
    return out


def check_new(cat: Catalog, table: str, rows: DataFrame) -> None:
    """Raises if new flat rows hold a null where none may be, repeat a key (their own or an old row's) or refer to no row."""
    t, old = cat.schema.tables[table], flatten(cat, table)
    for c in t.columns:
        if (not c.nullable or c.name in t.primary_key) and not rows.where(F.col(c.name).isNull()).isEmpty():
            raise DocshapeError("INTEGRITY", f"null in {table}.{c.name}")
    for key in [t.primary_key, *[u.columns for u in t.uniques if u.where is None]]:
        if not key or cat.layouts[table].kind.startswith("ref_"):  # a folded row is a set's element: adding it again changes nothing
            continue
        whole = rows.dropna(subset=list(key)).select(*key)
        twice = whole.groupBy(*key).count().where("count > 1")
        if not twice.isEmpty() or not old.select(*key).join(whole, list(key), "left_semi").isEmpty():
            raise DocshapeError("INTEGRITY", f"a key of {table} twice: {', '.join(key)}")
    for fk in t.foreign_keys:
        if fk.ref_table not in cat.layouts:
            continue
        keys = flatten(cat, fk.ref_table).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(fk.ref_columns)])
        if fk.ref_table == table:
            keys = keys.unionByName(rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(fk.ref_columns)]))
        lost = rows.dropna(subset=list(fk.columns)).join(keys, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fk.columns)], "left_anti")
        if not lost.isEmpty():
            raise DocshapeError("INTEGRITY", f"a new {table} row refers to no {fk.ref_table} row")


def insert(cat: Catalog, q: Insert, checked: bool = True) -> Catalog:
    """New rows; an embedded row needs a host, else nothing is changed and the insert fails.  Unless ``checked`` is false,
    rows that break a constraint of the schema are refused too, whether or not the layout would hold it by itself."""
    x = cat.layouts[q.table]
    root = _root(cat, q.table)
    rows = _literal_rows(cat, q, cat.roots[root].sparkSession)
    if checked:
        check_new(cat, q.table, rows)
    if x.kind == "root":
        return cat.with_root(root, cat.roots[root].unionByName(rows, allowMissingColumns=True))
    fk, key = x.rel.fk.columns, x.rel.fk.ref_columns
    host = flatten(cat, x.host)
    if not rows.join(host.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]), [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fk)], "left_anti").isEmpty():
        raise DocshapeError("INTEGRITY", f"no {x.host} row for a new {q.table} row")
    if x.host != root or x.kind == "object":
        return _rebuilt(cat, q.table, flatten(cat, q.table).unionByName(rows))
    docs = cat.roots[root]
    element = docs.schema[x.path].dataType.elementType
    new = F.col(x.fields[0]) if x.kind == "ref_scalars" else F.struct(*[(F.col(f) if f in x.fields else F.lit(None).cast(element[f].dataType)).alias(f) for f in element.names])
    grouped = rows.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(fk)]).agg(F.array_sort(F.collect_list(new.cast(element))).alias("_new"))
    empty = F.array().cast(docs.schema[x.path].dataType)
    have, more = F.coalesce(F.col(x.path), empty), F.coalesce(F.col("_new"), empty)
    both = F.array_sort(F.array_union(have, more)) if x.kind == "ref_scalars" else F.concat(have, more)
    joined = docs.join(grouped, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(key)], "left")
    return cat.with_root(root, joined.withColumn(x.path, F.when(F.col("_new").isNotNull(), both).otherwise(F.col(x.path))).select(*docs.columns))


def _resolver(cat: Catalog, table: str, element=None):
    """Columns of a root row, or of an element and its host."""
    x = cat.layouts[table]
    kinds = {f.name: f.dataType for f in flatten(cat, table).schema}
    key = dict(zip(x.rel.fk.columns, x.rel.fk.ref_columns)) if x.rel else {}

    def resolve(n):
        if n[0] != "col":
            return None
        if n[2] not in kinds or n[1] not in (None, table):
            raise DocshapeError("SEM012", f"no column {n[2]}")
        if element is None:
            return F.col(n[2]), kinds[n[2]]
        return (F.col(key[n[2]]) if n[2] in key else element if x.kind == "ref_scalars" else element[n[2]]), kinds[n[2]]

    return resolve


def _hit(where, resolve):
    return F.coalesce(to_column(where, resolve), F.lit(False)) if where is not None else F.lit(True)


def update(cat: Catalog, q: Update) -> Catalog:
    t, x, root = cat.schema.tables[q.table], cat.layouts[q.table], _root(cat, q.table)
    for c, _ in q.sets:
        if t.column(c) is None:
            raise DocshapeError("SEM012", f"no column {c}")
        if c in t.primary_key:
            raise DocshapeError("NOT_TRANSLATED", "a primary key cannot be updated")
        if x.rel and c in x.rel.fk.columns:
            raise DocshapeError("NOT_TRANSLATED", "a key that nesting implies cannot be updated")
    if x.kind == "ref_scalars":
        raise DocshapeError("NOT_TRANSLATED", "folded keys cannot be updated")
    if x.kind != "root" and x.host != root:
        rows, r = flatten(cat, q.table), _resolver(cat, q.table)
        kinds = {f.name: f.dataType for f in rows.schema}
        return _rebuilt(cat, q.table, rows.select(*[_set(q, c, F.col(c), r, kinds[c]).alias(c) for c in rows.columns]))
    docs = cat.roots[root]
    if x.kind == "root":
        r = _resolver(cat, q.table)
        return cat.with_root(root, docs.select(*[_set(q, c, F.col(f"`{c}`"), r, docs.schema[c].dataType).alias(c) for c in docs.columns]))

    def changed(e):
        r, kind = _resolver(cat, q.table, e), docs.schema[x.path].dataType
        kind = kind if x.kind == "object" else kind.elementType
        return F.struct(*[_set(q, f.name, e[f.name], r, f.dataType).alias(f.name) for f in kind])

    new = F.when(F.col(x.path).isNotNull(), changed(F.col(x.path))) if x.kind == "object" else F.transform(x.path, changed)
    return cat.with_root(root, docs.withColumn(x.path, new))


def _set(q: Update, name: str, old, resolve, kind):
    for c, v in q.sets:
        if c == name:
            return F.when(_hit(q.where, resolve), to_column(v, resolve).cast(kind)).otherwise(old)
    return old


def delete(cat: Catalog, q: Delete) -> Catalog:
    """Rows that satisfy the condition go, with what is nested in them; other tables are not touched."""
    x, root = cat.layouts[q.table], _root(cat, q.table)
    docs = cat.roots[root]
    if x.kind == "root":
        return cat.with_root(root, docs.where(~_hit(q.where, _resolver(cat, q.table))))
    if x.host != root:
        return _rebuilt(cat, q.table, flatten(cat, q.table).where(~_hit(q.where, _resolver(cat, q.table))))
    if x.kind == "object":
        new = F.when(~_hit(q.where, _resolver(cat, q.table, F.col(x.path))), F.col(x.path))
    else:
        kept = F.filter(x.path, lambda e: ~_hit(q.where, _resolver(cat, q.table, e)))
        new = F.when(F.size(kept) > 0, kept)  # no children is no array
    return cat.with_root(root, docs.withColumn(x.path, new))


def matched(cat: Catalog, q) -> int:
    """The number of rows that a write is about: those that an INSERT gives, or that its condition selects."""
    if isinstance(q, Insert):
        return len(q.rows)
    return flatten(cat, q.table).where(_hit(q.where, _resolver(cat, q.table))).count()


def generated(cat: Catalog, q):
    """An INSERT with the values of called defaults (a time, a random id) computed once and written out, so that several catalogs get
    the same rows; other statements as they are."""
    if not isinstance(q, Insert) or q.table not in cat.schema.tables:
        return q
    t = cat.schema.tables[q.table]
    columns = list(q.columns or t.names())
    spark = cat.roots[_root(cat, q.table)].sparkSession
    rows = [list(r) for r in q.rows]
    for c in t.columns:
        if c.default is None or c.default[0] != "call" or c.identity:
            continue
        at = columns.index(c.name) if c.name in columns else None
        if at is None:
            columns.append(c.name)
            rows = [[*r, None] for r in rows]
            at = -1
        for r in rows:
            if r[at] is None:
                v = spark.range(1).select(to_column(c.default, lambda n: None).cast(spark_type(c.type, c.size, c.array))).first()[0]
                r[at] = ("cast", ("lit", str(v), "text"), (c.type, c.size))
    return Insert(q.table, columns, rows)


def execute(cat: Catalog, *statements, checked: bool = True) -> Catalog:
    """The catalog after all statements (texts or parsed); if one fails none has happened.  ``checked`` is that of ``insert``."""
    for sql in statements:
        q = parse_query(sql) if isinstance(sql, str) else sql
        if getattr(q, "table", None) not in cat.schema.tables:
            raise DocshapeError("SEM012", "no such table, or not a write")
        cat = insert(cat, q, checked) if isinstance(q, Insert) else {Update: update, Delete: delete}[type(q)](cat, q)
    return cat


# ---- foreign-key actions, on flat tables ----


def delete_rows(schema, tables: dict[str, DataFrame], table: str, where) -> dict[str, DataFrame]:
    """The tables after deleting ``table``'s rows for which the Column ``where`` is true, with every ON DELETE action.

    RESTRICT and NO ACTION raise if a child is left.  Follows the foreign keys level by level, each level one
    semi-join.  Tables on a cycle of cascades are followed until no row is hit that is not gone yet; each of their levels is
    kept in the shared checkpoint folder, so that plans do not grow with the depth."""
    out = dict(tables)
    cascades = {t.name: {fk.ref_table for fk in t.foreign_keys if fk.on_delete == "CASCADE"} for t in schema.tables.values()}

    def on_cycle(name: str) -> bool:
        seen, todo = set(), [name]
        while todo:
            for p in cascades.get(todo.pop(), ()):
                if p == name:
                    return True
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return False

    frontier = [(table, out[table].where(F.coalesce(where, F.lit(False))))]
    out[table] = out[table].where(~F.coalesce(where, F.lit(False)))
    while frontier:
        parent, gone = frontier.pop(0)
        for t in schema.tables.values():
            for fk in t.foreign_keys:
                if fk.ref_table != parent or t.name not in out:
                    continue
                keys = gone.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(fk.ref_columns)]).distinct()
                on = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(fk.columns)]
                child = out[t.name]
                if fk.on_delete == "CASCADE":
                    hit, kept = child.join(keys, on, "left_semi"), child.join(keys, on, "left_anti")
                    if on_cycle(t.name):
                        hit = _kept(hit)
                        if hit.isEmpty():
                            continue
                        kept = _kept(kept)
                    out[t.name] = kept
                    frontier.append((t.name, hit))
                elif fk.on_delete in ("SET NULL", "SET DEFAULT"):
                    marked = child.join(keys.withColumn("_hit", F.lit(True)), on, "left")

                    def value(c, fk=fk, t=t):
                        d = t.column(c).default
                        return F.lit(None) if fk.on_delete == "SET NULL" or d is None else to_column(d, lambda n: None)

                    kinds = {f.name: f.dataType for f in child.schema}
                    out[t.name] = marked.select(*[(F.when(F.col("_hit"), value(c).cast(kinds[c])).otherwise(F.col(c)) if c in fk.columns else F.col(c)).alias(c) for c in child.columns])
                else:
                    if not child.join(keys, on, "left_semi").isEmpty():
                        raise DocshapeError("INTEGRITY", f"{t.name} rows still refer to {parent}")
    return out


def _kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that the session names for checkpoints; a local master may use one of its own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise DocshapeError("CONFIG", "set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docshape-checkpoint-"))
    return df.checkpoint()


def update_key(schema, tables: dict[str, DataFrame], table: str, column: str, new, where) -> dict[str, DataFrame]:
    """The tables after changing a key column, with ON UPDATE CASCADE at every depth: a child's column that others refer to
    changes for them too.  Other actions raise if a child refers to a changed key."""
    hit = F.coalesce(where, F.lit(False))
    old = tables[table]
    kind = old.schema[column].dataType
    moved = old.where(hit).select(F.col(column).alias("_old"), new.cast(kind).alias("_new")).distinct()
    out = dict(tables) | {table: old.withColumn(column, F.when(hit, new.cast(kind)).otherwise(F.col(column)))}
    todo, done = [(table, column)], {(table, column)}
    while todo:
        parent, key = todo.pop(0)
        for t in schema.tables.values():
            for fk in t.foreign_keys:
                if fk.ref_table != parent or key not in fk.ref_columns or t.name not in out:
                    continue
                c = fk.columns[fk.ref_columns.index(key)]
                if (t.name, c) in done:
                    continue
                child = out[t.name]
                if fk.on_update == "CASCADE":
                    joined = child.join(moved, F.col(c) == F.col("_old"), "left")
                    out[t.name] = joined.select(*[(F.when(F.col("_old").isNotNull(), F.col("_new")).otherwise(F.col(c)) if n == c else F.col(n)).alias(n) for n in child.columns])
                    done.add((t.name, c))
                    todo.append((t.name, c))
                elif not child.join(moved, F.col(c) == F.col("_old"), "left_semi").isEmpty():
                    raise DocshapeError("INTEGRITY", f"{t.name} rows still refer to {parent}")
    return out
