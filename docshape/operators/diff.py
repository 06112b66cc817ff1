"""Comparing results: multisets with a numeric tolerance, and ordered results with ties."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TOLERANCE = 1e-9
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def normalize(df: DataFrame) -> DataFrame:
    """Reals as doubles, times to the millisecond, integers as longs."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _REAL):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_trunc("millisecond", c).cast(f.dataType)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(x):
    """A real Column to six significant digits: only an order in which nearly equal values lie together, never a test of equality."""
    digits = 5 - F.floor(F.log10(F.abs(x)))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits))


def values_equal(a, b, tolerance: float = TOLERANCE):
    """Equality of two real Columns up to a relative tolerance; nulls are equal to nulls."""
    return a.eqNullSafe(b) | (F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, after normalisation, that one side has more often: side, n and the columns.

    One aggregation counts exactly.  If there are real columns, what it leaves over is paired once more: rows that agree in
    all other columns, in the order of their reals, and pairs whose reals are equal within the tolerance are dropped."""
    a, b = normalize(left), normalize(right.toDF(*left.columns))
    names = [f"c{i}" for i in range(len(left.columns))]
    both = a.toDF(*names).withColumn("_d", F.lit(1)).unionByName(b.toDF(*names).withColumn("_d", F.lit(-1)))
    counted = both.groupBy(*names).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    real = [n for n, f in zip(names, a.schema) if isinstance(f.dataType, T.DoubleType)]
    if real:
        plain = [n for n in names if n not in real]
        over = counted.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_d")))).withColumn("_side", F.signum("_d").cast("int"))
        w = W.partitionBy("_side", *plain).orderBy(*[rounded(F.col(n)) for n in real], *real)
        over = over.withColumn("_k", F.row_number().over(w))
        x = over.where("_side = 1").select(F.struct(*names).alias("x"), "_k")
        y = over.where("_side = -1").select(F.struct(*names).alias("y"), F.col("_k").alias("_j"))
        on = (F.col("_k") == F.col("_j"))
        for n in plain:
            on = on & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
        same = F.lit(True)
        for n in real:
            same = same & values_equal(F.col(f"x.{n}"), F.col(f"y.{n}"))
        pairs = x.join(y, on, "full").where(F.col("x").isNull() | F.col("y").isNull() | ~F.coalesce(same, F.lit(False)))
        ends = F.array(F.struct(F.lit(1).alias("_d"), F.col("x").alias("r")), F.struct(F.lit(-1).alias("_d"), F.col("y").alias("r")))
        counted = pairs.select(F.inline(ends)).where("r IS NOT NULL").groupBy("r").agg(F.sum("_d").alias("_d")).where("_d <> 0").select("r.*", "_d")
    return counted.select(F.when(F.col("_d") > 0, "left").otherwise("right").alias("side"), F.abs("_d").alias("n"), *[F.col(n).alias(c) for n, c in zip(names, left.columns)])


def same_multiset(left: DataFrame, right: DataFrame) -> bool:
    return len(left.columns) == len(right.columns) and multiset_diff(left, right).isEmpty()


def same_order(left: list[tuple], right: list[tuple], keys: list[int]) -> bool:
    """Whether two small collected results agree row by row, rows with equal sort keys in any order; reals to nine digits."""
    left, right = ([tuple(float(f"{v:.9g}") if isinstance(v, (float, Decimal)) else v for v in r) for r in x] for x in (left, right))
    if len(left) != len(right):
        return False
    at = 0
    while at < len(left):
        end, key = at, [left[at][k] for k in keys]
        while end < len(left) and [left[end][k] for k in keys] == key:
            end += 1
        if sorted(map(repr, left[at:end])) != sorted(map(repr, right[at:end])):
            return False
        at = end
    return True


def sample(diff: DataFrame, n: int = 5) -> list:
    """A few differing rows, left side first."""
    return diff.orderBy("side").limit(n).collect()


def hypothesis(left: list, right: list, only_left: list, only_right: list, one_row: bool = False) -> str:
    """The likely reason why two results differ, from their rows and those that only one of them has; empty if none is known.

    ``one_row`` says that the query is an aggregate without groups, which has one row even over nothing."""
    if one_row and (len(left), len(right)) in ((1, 0), (0, 1)):
        return "an aggregate over nothing: one row on one side, none on the other"
    if len(only_left) == len(only_right):
        for a, b in ((x, y) for p, q in zip(only_left, only_right) for x, y in zip(p, q) if x != y):
            if None in (a, b):
                return "null on one side, zero on the other: an aggregate of no rows" if 0 in (a, b) else "null on one side only"
            if all(isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) for v in (a, b)):
                return "numbers of different exactness"
    if len(left) != len(right):
        return "different numbers of rows: a join or a filter takes nulls or missing values differently"
    return ""
