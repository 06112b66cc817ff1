"""Parser, validation, placement, guarantees, generation and comparison."""

import pytest

from docshape.model import DocshapeError, cycles, junctions
from docshape.operators import checks
from docshape.operators.diff import multiset_diff, same_order
from docshape.operators.reshape import build_layouts
from docshape.plans import guarantees, placement
from docshape.plans.sqlfront import parse_query, parse_schema, parse_script
from docshape.plans.validate import validate
from docshape.sources import datagen


@pytest.mark.parametrize("sql,code", [
    ("SELECT a FROM t UNION SELECT a FROM t", "UNSUPPORTED_SET_OPERATION"), ("WITH x AS (SELECT 1) SELECT * FROM x", "UNSUPPORTED_CTE"), ("SELECT a FROM t RIGHT JOIN u ON t.a = u.a", "UNSUPPORTED_OUTER_JOIN"),
    ("SELECT a FROM t CROSS JOIN u", "UNSUPPORTED_JOIN"), ("SELECT a FROM t JOIN u USING (a)", "UNSUPPORTED_JOIN"), ("SELECT row_number() OVER (ORDER BY a) FROM t", "UNSUPPORTED_WINDOW_FUNCTION"),
    ("SELECT a FROM t WHERE a IN (SELECT 1)", "UNSUPPORTED_SUBQUERY"), ("SELECT DISTINCT ON (a) a FROM t", "UNSUPPORTED_QUERY_FEATURE"), ("DELETE FROM t USING u", "UNSUPPORTED_QUERY_FEATURE"),
    ("SELECT a FROM t FOR UPDATE", "UNSUPPORTED_QUERY_FEATURE"), ("SELECT FROM", "PARSE001"), ("SELECT a FROM (SELECT 1) x", "UNSUPPORTED_SUBQUERY"),
])
def test_rejections(sql, code):
    with pytest.raises(DocshapeError) as e:
        parse_query(sql)
    assert e.value.code == code


def test_ddl_and_validation():
    s, d = parse_schema("""
    CREATE TYPE mood AS ENUM ('up', 'down');
    CREATE TABLE a (id serial PRIMARY KEY, m mood DEFAULT 'up', n varchar(5) UNIQUE, d numeric(8,2)[] , at timestamp with time zone DEFAULT now(), b_id bigint REFERENCES b ON DELETE SET NULL);
    CREATE TABLE b (id bigint PRIMARY KEY, a_id int NOT NULL, CONSTRAINT x FOREIGN KEY (a_id) REFERENCES a (id) ON DELETE SET NULL ON UPDATE CASCADE);
    CREATE UNIQUE INDEX i ON a (n) WHERE n IS NOT NULL; CREATE VIEW v AS SELECT 1; ALTER TABLE a ADD CONSTRAINT c CHECK (length(n) > 1); CREATE TABLE k (x nosuch);
    """)
    assert s.enums["mood"] == ("up", "down") and s.tables["a"].column("id").identity and s.tables["a"].column("d").array and s.tables["a"].column("at").type == "TIMESTAMPTZ"
    assert s.tables["b"].foreign_keys[0].on_update == "CASCADE" and s.tables["b"].foreign_keys[0].on_delete == "SET NULL"
    assert {"UNSUPPORTED_VIEW", "PARSE008"} <= {x.code for x in d}  # an unknown type; a known one without counterpart is PARSE007 and len(s.tables["a"].checks) == 1
    assert {"SEM008", "SEM009", "SEM010"} <= {x.code for x in validate(s)} and cycles(s) == [["a", "b"]]


@pytest.mark.parametrize("sql,codes", [
    ("CREATE TABLE t (a int); CREATE TABLE t (b int)", {"PARSE009"}), ("CREATE TYPE e AS ENUM ('a'); CREATE TYPE e AS ENUM ('b')", {"PARSE009"}), ("CREATE TABLE t (a money)", {"PARSE007"}), ("CREATE TABLE t (a nosuch)", {"PARSE008"}),
    ("CREATE TABLE t (a int) INHERITS (u)", {"UNSUPPORTED_INHERITANCE"}), ("CREATE TABLE t (a int) PARTITION BY RANGE (a)", {"UNSUPPORTED_PARTITIONING"}), ("CREATE TABLE t AS SELECT 1", {"UNSUPPORTED_CREATE_TABLE_AS"}),
    ("CREATE TABLE t (a int, EXCLUDE USING gist (a WITH =))", {"UNSUPPORTED_EXCLUSION_CONSTRAINT"}), ("CREATE TABLE t (a int); ALTER TABLE t DROP COLUMN a", {"UNSUPPORTED_ALTER_ACTION"}),
    ("CREATE TABLE t (a text); CREATE INDEX i ON t (lower(a))", {"UNSUPPORTED_EXPRESSION_INDEX"}), ("CREATE TABLE t (a int); CREATE INDEX i ON t USING btree (a DESC NULLS LAST)", set()), ("CREATE FUNCTION f() RETURNS int AS $$ SELECT 1; $$", {"UNSUPPORTED_FUNCTION"}),
    ("DROP TABLE t", {"UNSUPPORTED_STATEMENT"}), ("SET x = 1", {"PARSE003"}), ("FROB x", {"PARSE002"}), ("CREATE TABLE t (a int, a int)", {"SEM006"}),
    ("BEGIN; ROLLBACK", {"UNSUPPORTED_ROLLBACK"}), ("COMMIT", {"PARSE004"}), ("BEGIN; BEGIN; COMMIT", {"PARSE004"}), ("BEGIN; DELETE FROM t", {"PARSE004"}), ("", set()),
])
def test_codes(sql, codes):
    assert {d.code for d in parse_script(sql).diagnostics} == codes


def test_blocks():
    script = parse_script("SELECT a FROM t; BEGIN; UPDATE t SET a = 1; DELETE FROM u; COMMIT; BEGIN; END; START TRANSACTION; DELETE FROM t; COMMIT;")
    assert [i for i, _ in script.statements()] == ["q1", "q2", "q3", "q4"] and [(b.id, len(b.statements)) for b in script.blocks()] == [("t1", 2), ("t2", 1)]


@pytest.mark.parametrize("pattern,escape,hits", [
    ("a!%b", "!", ["a%b"]), ("a!%%", "!", ["a%b", "a%bc"]), ("a\\_b", "\\", ["a_b"]), ("a\\\\b", "\\", ["a\\b"]), ("a\\b", "", ["a\\b"]), ("a\\%", "!", ["a\\b"]), ("!a_b", "!", ["a%b", "a_b", "axb", "a\\b"]), ("", "!", [""]),
])
def test_like_escapes(spark, pattern, escape, hits):
    from docshape.operators.reshape import nest
    from docshape.plans.query import run_select

    s = parse_schema("CREATE TABLE t (v text)")[0]
    rows = spark.createDataFrame([(x,) for x in ("a%b", "a%bc", "a_b", "axb", "a\\b", "", None)], "v string")
    got = run_select(nest(s, build_layouts(s, []), {"t": rows}), f"SELECT v FROM t WHERE v LIKE '{pattern}' ESCAPE '{escape}'")
    assert sorted(r.v for r in got.collect()) == sorted(hits)


PARENT = "CREATE TABLE p (id int PRIMARY KEY, name text);"


@pytest.mark.parametrize("child,score,decision", [
    ("CREATE TABLE c (p_id int PRIMARY KEY REFERENCES p ON DELETE CASCADE, t text);", 0.64, "EMBED"), ("CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE);", 0.56, "EMBED"),
    ("CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p);", 0.46, "REFERENCE"), ("CREATE TABLE c (id int PRIMARY KEY, c_id int REFERENCES c ON DELETE SET NULL);", 0.44, "REFERENCE"),
])
def test_scores(child, score, decision):
    s = parse_schema(PARENT + child)[0]
    (d,) = placement.plan(s, placement.features(s)).values()
    assert abs(d.score - score) < 1e-9 and d.decision == decision


def test_plan_constraints():
    s = parse_schema(PARENT + "CREATE TABLE t (id int PRIMARY KEY); CREATE TABLE j (p_id int REFERENCES p ON DELETE CASCADE, t_id int REFERENCES t ON DELETE CASCADE, PRIMARY KEY (p_id, t_id)); CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p, t_id int NOT NULL REFERENCES t ON DELETE CASCADE)")[0]
    assert [j.table for j in junctions(s)] == ["j"]
    out = placement.plan(s, placement.features(s))
    assert out["m2n:j"].decision == "REF_ARRAY" and out["fk:c.t_id->t.id"].decision == "EMBED" and out["fk:c.p_id->p.id"].decision == "REFERENCE"
    big = placement.plan(s, placement.features(s, hints={"fk:c.t_id->t.id": {"children": 5000}}))
    assert big["fk:c.t_id->t.id"].decision == "REFERENCE"


def test_guarantees():
    s = parse_schema(PARENT + "CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE, v numeric(5,2) CHECK (v > 0))")[0]
    rel = "fk:c.p_id->p.id"
    for embed, want in (([], "BROKEN"), ([rel], "SAFE")):
        got = {v.node: v for v in guarantees.verdicts(s, build_layouts(s, embed))}
        assert got["cascade_delete:" + rel.removeprefix("fk:")].verdict == want and got["type:c.v"].verdict == "CHANGED" and got["check:c.v_0"].verdict == "SAFE"
    assert guarantees.worst(["SAFE", "BROKEN", "CHANGED"]) == "BROKEN"


def test_generated_rows_keep_all_guarantees(spark):
    s = parse_schema("""CREATE TYPE k AS ENUM ('x', 'y'); CREATE TABLE p (id int PRIMARY KEY, code varchar(6) UNIQUE, kind k NOT NULL, n int CHECK (n BETWEEN 3 AND 9), w text CHECK (w IN ('a', 'b')));
    CREATE TABLE o (p_id int PRIMARY KEY REFERENCES p, d date, u uuid); CREATE TABLE c (id bigserial PRIMARY KEY, p_id int NOT NULL REFERENCES p, up bigint REFERENCES c);
    CREATE TABLE m (p_id int REFERENCES p, c_id bigint REFERENCES c, PRIMARY KEY (p_id, c_id));""")[0]
    tables = datagen.generate(spark, s, seed=3, rows=60)
    bad = [r for r in checks.audit(s, tables).collect() if r.violations]
    assert not bad and tables["c"].count() == 60
    assert tables["p"].collect() == datagen.generate(spark, s, seed=3, rows=60)["p"].collect()


def test_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12), (2, None), (2, None)], "k int, v double")
    assert sorted((r.side, r.n, r.k) for r in multiset_diff(a, b).collect()) == [("left", 1, 1), ("right", 1, 2)]
    assert same_order([(1, "a"), (1, "b"), (2, "c")], [(1, "b"), (1, "a"), (2, "c")], [0]) and not same_order([(1, "a"), (2, "c")], [(2, "c"), (1, "a")], [0])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
