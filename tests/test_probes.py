"""Deliberate violations of each foreign key, in a nested and in a flat layout."""

from docshape.operators.reshape import build_layouts, nest
from docshape.plans.sqlfront import parse_schema
from docshape.probes import run_probes

DDL = """CREATE TABLE p (id int PRIMARY KEY, name text);
CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE ON UPDATE CASCADE, v int);
CREATE TABLE s (id int PRIMARY KEY, p_id int REFERENCES p ON DELETE SET NULL);
CREATE TABLE r (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE RESTRICT);
CREATE TABLE e (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE);
"""
_C = "fk:c.p_id->p.id"


def _found(spark, embed):
    schema = parse_schema(DDL)[0]
    rows = {
        "p": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), "c": spark.createDataFrame([(10, 1, 5), (11, 1, None), (12, 2, 7)], "id int, p_id int, v int"),
        "s": spark.createDataFrame([(20, 1), (21, None)], "id int, p_id int"), "r": spark.createDataFrame([(30, 2)], "id int, p_id int"), "e": spark.createDataFrame([], "id int, p_id int"),
    }
    cat = nest(schema, build_layouts(schema, embed), rows)
    return {(p.relationship[3], p.kind): p.outcome for p in run_probes(cat)}


def test_nested(spark):
    got = _found(spark, [_C])
    assert got["c", "delete"] == "HELD" and got["c", "orphan"] == "HELD"
    assert got["c", "key_update"] == "BROKEN"  # the key would move, the layout refuses
    assert got["s", "delete"] == "BROKEN" and got["s", "orphan"] == "BROKEN"
    assert got["r", "delete"] == "BROKEN" and got["r", "key_update"] == "HELD"  # both refuse the new key
    assert {got["e", k] for k in ("delete", "orphan", "key_update")} == {"SKIPPED"}


def test_flat(spark):
    got = _found(spark, [])
    assert got["c", "delete"] == "BROKEN" and got["c", "orphan"] == "BROKEN"


def test_query(spark):
    from docshape import queries as q

    rows = {(r.relationship, r.kind): r.outcome for r in q.guarantee_probes(spark, "/root/testdata/sf0.001").collect()}
    held = "fk:nation.n_regionkey->region.r_regionkey"
    assert rows[held, "delete"] == rows[held, "orphan"] == rows[held, "key_update"] == "HELD"
    assert rows["fk:supplier.s_nationkey->nation.n_nationkey", "delete"] == "BROKEN"
