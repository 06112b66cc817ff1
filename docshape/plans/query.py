"""SELECT over a catalog: the same answers whatever the nesting.

Tables are bound as columns named ``alias__column``.  A join along an embedded
edge whose host is in scope unnests the host's array instead of joining; any
other join uses the flat view of the table.  Everything else is Catalyst's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import DocshapeError
from ..operators.reshape import Catalog, rows_of
from .sqlfront import Select, parse_query

AGGREGATES = ("count", "sum", "avg", "min", "max")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# SQL types and their Spark types.
SPARK_TYPES = {
    "SMALLINT": "smallint", "INTEGER": "int", "BIGINT": "bigint", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "TIME": "string", "INTERVAL": "interval day to second", "UUID": "string", "JSON": "string", "JSONB": "string", "BYTEA": "binary",
}
_FUNCTIONS = {
    "upper": F.upper, "lower": F.lower, "abs": F.abs, "length": F.char_length, "char_length": F.char_length, "coalesce": F.coalesce, "greatest": F.greatest, "least": F.least, "trim": F.trim,
    "concat": F.concat, "nullif": F.nullif, "floor": F.floor, "ceil": F.ceil, "now": F.current_timestamp, "current_timestamp": F.current_timestamp, "current_date": F.current_date, "gen_random_uuid": F.uuid,
    "substring": lambda x, a, n=None: F.substr(x, a, n) if n is not None else F.substr(x, a),
}


def spark_type(base: str, size: tuple = (), array: bool = False) -> str:
    one = f"decimal({size[0]},{size[1] if len(size) > 1 else 0})" if base == "DECIMAL" and size else "decimal(38,18)" if base == "DECIMAL" else SPARK_TYPES.get(base, "string")
    return f"array<{one}>" if array else one


def conjuncts(x) -> list:
    if x is None:
        return []
    return conjuncts(x[2]) + conjuncts(x[3]) if x[0] == "op" and x[1] == "and" else [x]


def walk(x):
    """All expression nodes, the node itself first."""
    if isinstance(x, tuple) and x and isinstance(x[0], str):
        yield x
    if isinstance(x, (tuple, list)):
        for y in x:
            if isinstance(y, (tuple, list)):
                yield from walk(y)


def rewrite(x, f):
    """The expression with ``f`` applied to every node from the leaves up."""
    if isinstance(x, list):
        return [rewrite(y, f) for y in x]
    if not isinstance(x, tuple):
        return x
    out = tuple(rewrite(y, f) if isinstance(y, (tuple, list)) else y for y in x)
    return f(out) if out and isinstance(out[0], str) else out


def to_column(x, resolve) -> Column:
    """The expression as a Column; ``resolve(node)`` gives (Column, DataType) for columns and claimed nodes, else None."""
    return _convert(x, resolve)[0]


def like_pattern(pattern: str, escape: str) -> str:
    """A LIKE pattern with the escape character ``escape`` (or none) as one that escapes only %, _ and the backslash, by a backslash."""
    out, rest = [], iter(pattern)
    for ch in rest:
        if ch == escape:
            ch = next(rest, "")
            if not ch:
                raise DocshapeError("NOT_TRANSLATED", "a LIKE pattern must not end with its escape character")
            out.append("\\" + ch if ch in "%_\\" else ch)
        else:
            out.append("\\\\" if ch == "\\" else ch)
    return "".join(out)


def _convert(x, resolve) -> tuple[Column, bool]:
    """(Column, whether it is integral)"""
    got = resolve(x)
    if got is not None:
        return got[0], isinstance(got[1], _INTEGRAL)
    kind = x[0]
    if kind == "lit":
        if x[2] in ("date", "timestamp", "timestamptz", "time"):
            return F.lit(x[1]).cast({"date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "time": "string"}[x[2]]), False
        if x[2] == "dec":
            return F.lit(x[1]).cast("double"), False
        return F.lit(x[1]), x[2] == "int"
    if kind == "op":
        (a, ia), (b, ib) = _convert(x[2], resolve), _convert(x[3], resolve)
        op = x[1]
        if op == "/":  # as PostgreSQL: whole numbers divide to whole numbers
            return (F.call_function("div", a, b) if ia and ib else F.try_divide(a, b)), ia and ib
        made = {
            "or": lambda: a | b, "and": lambda: a & b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "%": lambda: a % b, "||": lambda: F.concat(a, b), "<=>": lambda: a.eqNullSafe(b),
        }[op]()
        return made, ia and ib and op in "+-*%"
    if kind == "not":
        return ~_convert(x[1], resolve)[0], False
    if kind == "neg":
        c, i = _convert(x[1], resolve)
        return -c, i
    if kind == "null":
        c = _convert(x[1], resolve)[0]
        return (c.isNotNull() if x[2] else c.isNull()), False
    if kind == "in":
        c = _convert(x[1], resolve)[0].isin(*[_convert(i, resolve)[0] for i in x[2]])
        return (~c if x[3] else c), False
    if kind == "between":
        c = _convert(x[1], resolve)[0].between(_convert(x[2], resolve)[0], _convert(x[3], resolve)[0])
        return (~c if x[4] else c), False
    if kind == "like":
        if x[2][0] != "lit":
            raise DocshapeError("NOT_TRANSLATED", "a LIKE pattern must be a literal")
        c = _convert(x[1], resolve)[0]
        pattern = like_pattern(x[2][1], x[5])
        c = c.ilike(pattern) if x[3] else c.like(pattern)
        return (~c if x[4] else c), False
    if kind == "cast":
        base, size, array = (*x[2], False)[:3] if len(x[2]) == 2 else x[2]
        return _convert(x[1], resolve)[0].cast(spark_type(base, size, array)), base in ("SMALLINT", "INTEGER", "BIGINT")
    if kind == "case":
        out = None
        for c, v in x[1]:
            c, v = _convert(c, resolve)[0], _convert(v, resolve)[0]
            out = F.when(c, v) if out is None else out.when(c, v)
        return (out.otherwise(_convert(x[2], resolve)[0]) if x[2] is not None else out), False
    if kind == "call":
        name = x[1]
        if name in AGGREGATES:
            raise DocshapeError("NOT_TRANSLATED", f"{name.upper()} is not allowed here")
        if name == "round":
            return F.round(_convert(x[2][0], resolve)[0], x[2][1][1] if len(x[2]) > 1 else 0), False
        if name == "extract":
            return F.extract(F.lit(x[2][0][1]), _convert(x[2][1], resolve)[0]), False
        if name in _FUNCTIONS:
            args = [_convert(a, resolve) for a in x[2]]
            return _FUNCTIONS[name](*[c for c, _ in args]), name in ("length", "char_length") or bool(args) and all(i for _, i in args) and name in ("abs", "coalesce", "greatest", "least")
        raise DocshapeError("UNSUPPORTED_FUNCTION_CALL", name)
    raise DocshapeError("NOT_TRANSLATED", f"{kind} is not allowed here")


def _physical(alias: str, name: str) -> str:
    return f"{alias}__{name}"


class _Plan:
    def __init__(self, cat: Catalog, s: Select, use_layout: bool):
        self.cat, self.s, self.use = cat, s, use_layout
        if s.source is None:
            raise DocshapeError("UNSUPPORTED_QUERY_FEATURE", "SELECT needs FROM")
        self.tables = dict([(s.source[1], s.source[0])] + [(a, t) for _, t, a, _ in s.joins])
        if len(self.tables) < 1 + len(s.joins):
            raise DocshapeError("SEM012", "an alias is used twice")
        for t in self.tables.values():
            if t not in cat.schema.tables:
                raise DocshapeError("SEM012", f"no table {t}")
        self.outputs_named = {a for _, a in s.items if a}
        self.canonical()
        self.needed = {a: set() for a in self.tables}
        every = [*self.items] + [c for *_, c in s.joins] + [s.where, s.having, *s.group, *[o[0] for o in s.order]]
        for x in every:
            for n in walk(x):
                if n[0] == "col" and n[1] in self.needed:
                    self.needed[n[1]].add(n[2])
        self.df: DataFrame | None = None
        self.have: set[str] = set()

    def canonical(self) -> None:
        """Every column gets its alias; stars are written out."""
        s = self.s

        def name(x, keep=frozenset()):
            if x[0] != "col":
                return x
            if x[1] is not None:
                if x[1] not in self.tables or x[2] not in self.cat.schema.tables[self.tables[x[1]]].names():
                    raise DocshapeError("SEM012", f"no column {x[1]}.{x[2]}")
                return x
            owners = [a for a, t in self.tables.items() if x[2] in self.cat.schema.tables[t].names()]
            if len(owners) > 1:
                raise DocshapeError("SEM012", f"column {x[2]} is ambiguous")
            if owners:
                return ("col", owners[0], x[2])
            if x[2] in keep:
                return x
            raise DocshapeError("SEM012", f"no column {x[2]}")

        items = []
        for x, a in s.items:
            if x[0] == "star":
                for alias, t in self.tables.items():
                    if x[1] in (None, alias):
                        items += [(("col", alias, c), c) for c in self.cat.schema.tables[t].names()]
            else:
                items.append((rewrite(x, name), a))
        self.raw = [a or (x[2] if x[0] == "col" else x[1] if x[0] == "call" and x[1] in AGGREGATES else f"column{i + 1}") for i, (x, a) in enumerate(items)]
        seen: dict[str, int] = {}
        self.names = []
        for n in self.raw:
            seen[n] = seen.get(n, 0) + 1
            self.names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        self.items = [x for x, _ in items]
        s.where = rewrite(s.where, name)
        s.joins = [(k, t, a, rewrite(c, name)) for k, t, a, c in s.joins]
        late = frozenset(self.outputs_named)
        pick = lambda x: self._late(rewrite(x, lambda n: name(n, late)))
        s.group, s.order = [pick(g) for g in s.group], [(pick(o), d, n) for o, d, n in s.order]
        s.having = rewrite(s.having, name)

    def _late(self, x):
        """Ordinals and output names stand for their expressions."""
        if x[0] == "lit" and x[2] == "int":
            if not 1 <= x[1] <= len(self.items):
                raise DocshapeError("NOT_TRANSLATED", f"no output {x[1]}")
            return self.items[x[1] - 1]
        if x[0] == "col" and x[1] is None:
            return self.items[self.raw.index(x[2])]
        return rewrite(x, lambda n: self.items[self.raw.index(n[2])] if n[0] == "col" and n[1] is None else n)

    def resolve(self, x):
        if x[0] != "col":
            return None
        p = _physical(x[1], x[2])
        return F.col(p), self.df.schema[p].dataType

    # FROM and JOIN

    def hosted(self, alias: str) -> list[str]:
        """The nested fields of a table that later joins may unnest."""
        if not self.use:
            return []
        joined = {t for _, t, _, _ in self.s.joins} | {self.s.source[0]}
        return [x.path for x in self.cat.children(self.tables[alias]) if x.table in joined]

    def bound(self, alias: str) -> DataFrame:
        t = self.tables[alias]
        nested = self.hosted(alias)
        df = rows_of(self.cat, t, [c for c in self.cat.schema.tables[t].names() if c in self.needed[alias]] or self.cat.schema.tables[t].names()[:1], nested)
        return df.select(*[F.col(f"`{c}`").alias(_physical(alias, c)) for c in df.columns])

    def edge(self, alias: str, host: str, eqs: list) -> list | None:
        """The equalities left over if ``eqs`` follow the foreign key from an embedded table to its host; else None."""
        x = self.cat.layouts[self.tables[alias]]
        if not self.use or x.kind == "root" or x.host != self.tables[host]:
            return None
        pairs = {frozenset([("col", alias, c), ("col", host, k)]) for c, k in zip(x.rel.fk.columns, x.rel.fk.ref_columns)}
        got = [frozenset([e[2], e[3]]) for e in eqs]
        return [e for e, g in zip(eqs, got) if g not in pairs] if pairs <= set(got) else None

    def unnest(self, alias: str, host: str, outer: bool) -> None:
        """Adds the rows of an embedded table to its host's rows."""
        x = self.cat.layouts[self.tables[alias]]
        path, need = _physical(host, x.path), self.needed[alias]
        key = dict(zip(x.rel.fk.columns, x.rel.fk.ref_columns))
        own, nested = [f for f in x.fields if f in need], self.hosted(alias)
        rest = [F.col(f"`{c}`") for c in self.df.columns]
        if x.kind == "object":
            there = F.col(path).isNotNull()
            df = self.df if outer else self.df.where(there)
            get = {f: F.col(path)[f] for f in [*own, *nested]}
        elif x.kind == "ref_scalars":
            df = self.df.select(*rest, (F.explode_outer if outer else F.explode)(path).alias("_e"))
            there, get = F.col("_e").isNotNull(), {x.fields[0]: F.col("_e")}
            own = [x.fields[0]]
        else:
            read = [*own, *nested] or [x.fields[0]]
            zipped = F.arrays_zip(*[F.col(path)[f].alias(f) for f in read])
            df = self.df.select(*rest, (F.explode_outer if outer else F.explode)(zipped).alias("_e"))
            there, get = F.col("_e").isNotNull(), {f: F.col("_e")[f] for f in read}
        keys = [F.when(there, F.col(_physical(host, key[c]))).alias(_physical(alias, c)) for c in key if c in need]
        self.df = df.select(*rest, *keys, *[get[f].alias(_physical(alias, f)) for f in [*own, *nested]])

    def build_from(self) -> None:
        s = self.s
        alias = s.source[1]
        joins = list(s.joins)
        first = next((j for j in joins[:1] if self.edge(alias, j[2], self.equalities(j)) == []), None)
        x = self.cat.layouts[s.source[0]]
        if first:  # a child that joins its own host: the host's rows, unnested
            for c in x.rel.fk.ref_columns:
                self.needed[first[2]].add(c)
            self.df = self.bound(first[2])
            self.unnest(alias, first[2], outer=False)
            self.have = {alias, first[2]}
            joins.remove(first)
        else:
            for _, t, a, c in joins:
                y = self.cat.layouts[t]
                if y.rel is not None and y.host == self.tables[alias]:
                    self.needed[alias] |= set(y.rel.fk.ref_columns)
            self.df, self.have = self.bound(alias), {alias}
        for j in joins:
            self.join(j)

    def equalities(self, j) -> list:
        eqs = conjuncts(j[3])
        if any(e[0] != "op" or e[1] != "=" for e in eqs):
            raise DocshapeError("UNSUPPORTED_JOIN", "only equality joins")
        return eqs

    def join(self, j) -> None:
        kind, _, alias, cond = j
        eqs = self.equalities(j)
        for host in self.have:
            rest = self.edge(alias, host, eqs)
            path = _physical(host, self.cat.layouts[self.tables[alias]].path)
            if rest is not None and path in self.df.columns and (kind == "inner" or not rest):
                self.unnest(alias, host, outer=kind == "left")
                self.have.add(alias)
                for e in rest:
                    self.df = self.df.where(to_column(e, self.resolve))
                return
        right = self.bound(alias)
        left, types = self.df, {**{f.name: f.dataType for f in self.df.schema}, **{f.name: f.dataType for f in right.schema}}
        on = to_column(cond, lambda x: (F.col(_physical(x[1], x[2])), types[_physical(x[1], x[2])]) if x[0] == "col" else None)
        self.df = left.join(right, on, kind)
        self.have.add(alias)

    # the rest

    def run(self) -> DataFrame:
        s = self.s
        self.build_from()
        if s.where is not None:
            self.df = self.df.where(to_column(s.where, self.resolve))
        order = [o[0] for o in s.order]
        calls: list = []
        for x in [*self.items, s.having, *order]:
            calls += [n for n in walk(x) if n[0] == "call" and n[1] in AGGREGATES and n not in calls]
        resolve = self.resolve
        if calls or s.group or s.having is not None:
            resolve = self.aggregate(calls)
            if s.having is not None:
                self.df = self.df.where(to_column(s.having, resolve))
        out = [to_column(x, resolve).alias(n) for x, n in zip(self.items, self.names)]
        if s.distinct:
            self.df = self.df.select(*out).distinct()
            keys = []
            for x in order:
                if x not in self.items:
                    raise DocshapeError("NOT_TRANSLATED", "ORDER BY of SELECT DISTINCT must be an output")
                keys.append(F.col(f"`{self.names[self.items.index(x)]}`"))
        else:
            hidden = [to_column(x, resolve).alias(f"_o{i}") for i, x in enumerate(order)]
            self.df = self.df.select(*out, *hidden)
            keys = [F.col(f"_o{i}") for i in range(len(order))]
        if keys:
            put = []
            for c, (_, desc, first) in zip(keys, s.order):
                first = desc if first is None else first  # as PostgreSQL: nulls are largest
                put.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if first else c.asc_nulls_last()))
            self.df = self.df.orderBy(*put)
        if s.offset:
            self.df = self.df.offset(s.offset)
        if s.limit is not None:
            self.df = self.df.limit(s.limit)
        return self.df.select(*[F.col(f"`{n}`") for n in self.names])

    def aggregate(self, calls: list):
        s = self.s
        aggs, before = [], self.resolve
        for i, (_, name, args, distinct) in enumerate(calls):
            if name == "count" and (not args or args[0][0] == "star"):
                c = F.count(F.lit(1))
            else:
                xs = [to_column(a, before) for a in args]
                if name == "count":
                    c = F.countDistinct(*xs) if distinct else F.count(xs[0])
                elif distinct and name in ("sum", "avg"):
                    c = F.sum_distinct(xs[0]) if name == "sum" else F.sum_distinct(xs[0]) / F.countDistinct(xs[0])
                else:
                    c = getattr(F, name)(xs[0])
            aggs.append(c.alias(f"_a{i}"))
        keys = [to_column(g, before).alias(f"_g{i}") for i, g in enumerate(s.group)]
        if aggs:
            self.df = self.df.groupBy(*keys).agg(*aggs)
        else:
            self.df = self.df.select(*keys).distinct()
        groups = list(s.group)

        def resolve(x):
            if x in groups:
                n = f"_g{groups.index(x)}"
            elif x[0] == "call" and x[1] in AGGREGATES:
                n = f"_a{calls.index(x)}"
            elif x[0] == "col":
                raise DocshapeError("NOT_TRANSLATED", f"{x[1]}.{x[2]} must be grouped or aggregated")
            else:
                return None
            return F.col(n), self.df.schema[n].dataType

        return resolve


def run_select(cat: Catalog, query: str | Select, use_layout: bool = True) -> DataFrame:
    """The answer of a SELECT; with ``use_layout`` off every table is flattened first (the reference path)."""
    s = parse_query(query) if isinstance(query, str) else query
    if not isinstance(s, Select):
        raise DocshapeError("NOT_TRANSLATED", "not a SELECT")
    return _Plan(cat, s, use_layout).run()
