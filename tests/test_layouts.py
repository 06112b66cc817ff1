"""Every query over every layout gives the flat answer; nesting loses nothing."""

import itertools

import pytest
from pyspark.sql import functions as F

from docshape.model import DocshapeError
from docshape.operators.diff import same_multiset
from docshape.operators.dml import delete_rows, execute, update_key
from docshape.operators.reshape import build_layouts, flatten, nest
from docshape.plans.query import run_select
from docshape.plans.sqlfront import parse_schema

DDL = """
CREATE TABLE shops (id int PRIMARY KEY, name text NOT NULL, tier text);
CREATE TABLE bills (id int PRIMARY KEY, shop_id int NOT NULL REFERENCES shops ON DELETE CASCADE, total numeric(10,2) NOT NULL, note text);
CREATE TABLE lines (id int PRIMARY KEY, bill_id int NOT NULL REFERENCES bills ON DELETE CASCADE, sku text NOT NULL, qty int NOT NULL CHECK (qty > 0));
CREATE TABLE cards (shop_id int PRIMARY KEY REFERENCES shops, bio text);
CREATE TABLE tags (id int PRIMARY KEY, label text NOT NULL);
CREATE TABLE shop_tags (shop_id int REFERENCES shops, tag_id int REFERENCES tags, PRIMARY KEY (shop_id, tag_id));
"""
SCHEMA = parse_schema(DDL)[0]
B, L, C = "fk:bills.shop_id->shops.id", "fk:lines.bill_id->bills.id", "fk:cards.shop_id->shops.id"
LAYOUTS = {"flat": ([], {}), "one": ([L, C], {}), "two": ([B, L, C], {}), "folded": ([B], {"shop_tags": "shops"})}


@pytest.fixture(scope="module")
def flat(spark):
    from decimal import Decimal as D

    make = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    return {
        "shops": make([(1, "a", "x"), (2, "b", None), (3, "c", "y"), (4, "d", None)], "id int, name string, tier string"),
        "bills": make([(10, 1, D("5.00"), None), (11, 1, D("7.50"), "n"), (12, 2, D("0.00"), "m"), (13, 3, D("2.25"), None)], "id int, shop_id int, total decimal(10,2), note string"),
        "lines": make([(100, 10, "s", 1), (101, 10, "t", 2), (102, 11, "s", 3), (103, 13, "u", 7)], "id int, bill_id int, sku string, qty int"),
        "cards": make([(1, "hello"), (3, None)], "shop_id int, bio string"),
        "tags": make([(1, "red"), (2, "blue")], "id int, label string"),
        "shop_tags": make([(1, 1), (1, 2), (2, 1)], "shop_id int, tag_id int"),
    }


def catalog(flat, name):
    embed, fold = LAYOUTS[name]
    return nest(SCHEMA, build_layouts(SCHEMA, embed, fold), flat)


QUERIES = [
    "SELECT id, name FROM shops WHERE tier IS NULL ORDER BY id",
    "SELECT s.name, b.total FROM shops s JOIN bills b ON b.shop_id = s.id",
    "SELECT s.name, b.id AS bill, b.shop_id FROM shops s LEFT JOIN bills b ON b.shop_id = s.id",
    "SELECT s.name, l.sku, l.qty FROM shops s JOIN bills b ON b.shop_id = s.id JOIN lines l ON l.bill_id = b.id WHERE l.qty > 1",
    "SELECT s.name, COUNT(l.id) AS n, SUM(l.qty) AS q FROM shops s LEFT JOIN bills b ON b.shop_id = s.id LEFT JOIN lines l ON l.bill_id = b.id GROUP BY s.name",
    "SELECT l.id, b.total FROM lines l JOIN bills b ON l.bill_id = b.id",
    "SELECT s.id, c.bio FROM shops s JOIN cards c ON c.shop_id = s.id",
    "SELECT s.id, c.shop_id AS k, c.bio FROM shops s LEFT JOIN cards c ON c.shop_id = s.id",
    "SELECT s.name, t.label FROM shops s JOIN shop_tags x ON x.shop_id = s.id JOIN tags t ON t.id = x.tag_id",
    "SELECT tag_id, COUNT(*) AS n FROM shop_tags GROUP BY tag_id HAVING COUNT(*) > 1",
    "SELECT DISTINCT sku FROM lines ORDER BY sku DESC LIMIT 2 OFFSET 1",
    "SELECT COUNT(*) AS n, SUM(total) AS t FROM bills WHERE id > 1000",
    "SELECT * FROM lines WHERE sku NOT IN ('s', NULL)",
    "SELECT qty / 2 AS h, COUNT(DISTINCT sku) AS n FROM lines GROUP BY 1",
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_round_trip(flat, layout):
    cat = catalog(flat, layout)
    for t, df in flat.items():
        assert flatten(cat, t).columns == SCHEMA.tables[t].names()
        assert same_multiset(flatten(cat, t), df), t


@pytest.mark.parametrize("layout,sql", list(itertools.product(["one", "two", "folded"], QUERIES)))
def test_same_answer(flat, layout, sql):
    want = run_select(catalog(flat, "flat"), sql, use_layout=False)
    assert same_multiset(run_select(catalog(flat, layout), sql), want)


WRITES = [
    "INSERT INTO lines VALUES (200, 12, 'z', 9)", "INSERT INTO bills (id, shop_id, total) VALUES (50, 4, 1)", "INSERT INTO shops (id, name) VALUES (9, 'n')", "UPDATE lines SET qty = qty + 1 WHERE bill_id = 10 AND sku = 't'",
    "UPDATE bills SET note = NULL WHERE id = 11", "UPDATE cards SET bio = 'new' WHERE shop_id = 3", "DELETE FROM lines WHERE qty >= 3", "DELETE FROM cards WHERE shop_id = 1", "DELETE FROM shop_tags WHERE tag_id = 1",
    "INSERT INTO shop_tags VALUES (3, 2)",
]


@pytest.mark.parametrize("sql", WRITES)
def test_writes(flat, sql):
    want = execute(catalog(flat, "flat"), sql)
    for layout in ("one", "two", "folded"):
        got = execute(catalog(flat, layout), sql)
        for t in flat:
            assert same_multiset(flatten(got, t), flatten(want, t)), (layout, t)


def test_write_guards(flat):
    cat = catalog(flat, "one")
    for sql in ("UPDATE lines SET id = 1", "UPDATE lines SET bill_id = 1", "INSERT INTO lines VALUES (1, 999, 'x', 1)", "UPDATE nothing SET a = 1"):
        with pytest.raises(DocshapeError):
            execute(cat, sql)


def test_foreign_key_actions(flat):
    out = delete_rows(SCHEMA, {k: flat[k] for k in ("shops", "bills", "lines")}, "shops", F.col("id") == 1)
    assert {r.id for r in out["bills"].collect()} == {12, 13} and {r.id for r in out["lines"].collect()} == {103}
    with pytest.raises(DocshapeError):
        delete_rows(SCHEMA, flat, "tags", F.col("id") == 1)
    with pytest.raises(DocshapeError):
        update_key(SCHEMA, flat, "tags", "id", F.lit(7), F.col("id") == 1)


def test_nullable_key_is_not_embedded():
    s = parse_schema("CREATE TABLE p (id int PRIMARY KEY); CREATE TABLE c (id int PRIMARY KEY, p_id int REFERENCES p)")[0]
    with pytest.raises(DocshapeError):
        build_layouts(s, ["fk:c.p_id->p.id"])


def test_nested_read_is_pruned(spark, flat, tmp_path):
    cat = catalog(flat, "one")
    path = str(tmp_path / "bills")
    cat.roots["bills"].write.parquet(path)
    cat = cat.with_root("bills", spark.read.parquet(path))
    df = run_select(cat, "SELECT b.id, l.qty FROM bills b JOIN lines l ON l.bill_id = b.id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "sku" not in plan.split("ReadSchema:")[1].splitlines()[0] and "Join" not in plan
