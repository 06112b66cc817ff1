"""Foreign-key actions on cycles and in depth, checks of new rows, comparison with a tolerance, versions of a catalog."""

import pytest
from pyspark.sql import functions as F

from docshape import queries
from docshape.model import DocshapeError
from docshape.operators import diff, dml
from docshape.operators.reshape import build_layouts, flatten, nest
from docshape.plans.guarantees import verdicts
from docshape.plans import sqlfront
from docshape.plans.sqlfront import parse_query
from docshape.sources import tables


def parse_schema(sql):
    return sqlfront.parse_schema(sql)[0]


def test_delete_follows_a_cycle_of_cascades(spark):
    schema = parse_schema(
        "CREATE TABLE a (id INT PRIMARY KEY, b_id INT); CREATE TABLE b (id INT PRIMARY KEY, a_id INT REFERENCES a(id) ON DELETE CASCADE);"
        "ALTER TABLE a ADD FOREIGN KEY (b_id) REFERENCES b(id) ON DELETE CASCADE;"
    )
    a = spark.createDataFrame([(1, None), (2, 11), (3, 12), (4, 13)], "id int, b_id int")
    b = spark.createDataFrame([(11, 1), (12, 2), (13, 4)], "id int, a_id int")
    out = dml.delete_rows(schema, {"a": a, "b": b}, "a", F.col("id") == 1)
    assert [r.id for r in out["a"].collect()] == [4] and [r.id for r in out["b"].collect()] == [13]


def test_a_changed_key_is_followed_in_depth(spark):
    schema = parse_schema(
        "CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY REFERENCES a(id) ON UPDATE CASCADE);"
        "CREATE TABLE c (id INT PRIMARY KEY, b_id INT REFERENCES b(id) ON UPDATE CASCADE);"
    )
    t = {"a": spark.createDataFrame([(1,), (2,)], "id int"), "b": spark.createDataFrame([(1,), (2,)], "id int"), "c": spark.createDataFrame([(7, 1), (8, 2)], "id int, b_id int")}
    out = dml.update_key(schema, t, "a", "id", F.lit(9), F.col("id") == 1)
    assert sorted(r.id for r in out["b"].collect()) == [2, 9] and sorted(map(tuple, out["c"].collect())) == [(7, 9), (8, 2)]


_SHOP = "CREATE TABLE p (id INT PRIMARY KEY, name TEXT NOT NULL, code TEXT UNIQUE); CREATE TABLE q (id INT PRIMARY KEY, p_id INT REFERENCES p(id));"


def _shop(spark):
    schema = parse_schema(_SHOP)
    flat = {"p": spark.createDataFrame([(1, "x", "k")], "id int, name string, code string"), "q": spark.createDataFrame([(5, 1)], "id int, p_id int")}
    return nest(schema, build_layouts(schema, []), flat)


@pytest.mark.parametrize("sql", [
    "INSERT INTO p VALUES (1, 'y', 'l')", "INSERT INTO p VALUES (2, NULL, 'l')", "INSERT INTO p VALUES (2, 'y', 'k')", "INSERT INTO p VALUES (2, 'y', 'l'), (2, 'z', 'm')",
    "INSERT INTO p VALUES (NULL, 'y', 'l')", "INSERT INTO q VALUES (6, 77)",
])
def test_new_rows_are_checked(spark, sql):
    with pytest.raises(DocshapeError, match="INTEGRITY"):
        dml.execute(_shop(spark), sql)


def test_rows_that_keep_the_rules_are_taken(spark):
    got = dml.execute(_shop(spark), "INSERT INTO p VALUES (2, 'y', NULL), (3, 'z', NULL)", "INSERT INTO q VALUES (6, NULL), (7, 2)")
    assert flatten(got, "p").count() == 3 and flatten(got, "q").count() == 3


def test_reals_are_compared_with_a_tolerance(spark):
    d = lambda *x: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, v double")
    assert not diff.same_multiset(d(1_000_000), d(1_000_004)) and diff.same_multiset(d(1), d(1 + 1e-12)) and not diff.same_multiset(d(1), d(1 + 1e-6))
    same = spark.createDataFrame([("a", 0.1 + 0.2), ("a", 0.3), ("b", None), ("b", float("nan"))], "k string, v double")
    other = spark.createDataFrame([("b", float("nan")), ("a", 0.3), ("a", 0.3), ("b", None)], "k string, v double")
    assert diff.same_multiset(same, other) and not diff.same_multiset(same, other.limit(3))
    # Equal within the tolerance, on two sides of a border of the rounding.
    assert diff.same_multiset(d(1.0000005 - 1e-13), d(1.0000005 + 1e-13))


def test_versions(spark, tmp_path):
    cat, folder = _shop(spark), str(tmp_path / "shop")
    assert tables.save(cat, spark, folder) == 1
    (tmp_path / "shop" / "half").mkdir()  # what a crash may leave
    assert tables.save(dml.execute(cat, "INSERT INTO p VALUES (2, 'y', 'l')"), spark, folder) == 2
    assert [flatten(tables.load(cat.schema, cat.layouts, spark, folder, v), "p").count() for v in (1, 2)] == [1, 2]
    assert tables.current(spark, folder) == 2 and flatten(tables.load(cat.schema, cat.layouts, spark, folder), "p").count() == 2


def test_verdicts_on_joins_and_aggregates():
    schema = parse_schema(_SHOP + "CREATE TABLE s (id INT PRIMARY KEY, p_id INT NOT NULL REFERENCES p(id), w DOUBLE PRECISION, n INT);")
    layouts = build_layouts(schema, [])

    def of(sql, rule):
        return [v.outcome for v in verdicts(schema, layouts, [parse_query(sql)]) if v.rule == rule]

    assert of("SELECT p.name FROM p LEFT JOIN s ON s.p_id = p.id", "EQ-JOIN") == ["LEFT_CLEAN"]
    assert of("SELECT p.name, s.w FROM p LEFT JOIN s ON s.p_id = p.id", "EQ-JOIN") == ["LEFT_NULLS"]
    assert of("SELECT p.name FROM p JOIN s ON s.p_id = p.id", "EQ-JOIN") == ["INNER_REFERENCED"]
    # A query has one verdict: CHANGED if one of its aggregates is.
    for call, outcome in (("AVG(n)", "CHANGED"), ("AVG(w)", "SAFE"), ("SUM(w)", "CHANGED"), ("COUNT(*)", "SAFE"), ("MIN(w)", "SAFE"), ("MIN(w), AVG(n)", "CHANGED")):
        assert of(f"SELECT {call} FROM s", "EQ-AGG") == [f"AGG_{outcome}"]
    assert of("SELECT p.name, SUM(s.w) FROM p LEFT JOIN s ON s.p_id = p.id GROUP BY p.name", "EQ-AGG") == ["AGG_CHANGED"]
    assert of("SELECT s.n, SUM(s.w) FROM s GROUP BY s.n", "EQ-AGG") == ["AGG_SAFE"]


def test_moved_prices_of_equal_keys_are_told_apart(spark, tmp_path):
    """A price that another row of its keys had before the change is a change all the same, as the SQL has it."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 1, 40712.38), (1, 1, 40712.39), (1, 1, 40712.39), (1, 1, 7.0), (1, 2, 5.0), (1, 2, 5.01), (2, 1, 3.00001), (2, 1, 3.00002), (2, 3, 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(queries.ORACLE["diff_reals"]).fetchall()
    assert sorted(map(tuple, queries.diff_reals(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 8
