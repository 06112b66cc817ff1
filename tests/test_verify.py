"""Differential runs and the command line."""

import json

from docshape import cli
from docshape.plans.sqlfront import parse_schema
from docshape.verify import compile_schema, layouts_of, verify

DDL = """CREATE TABLE p (id int PRIMARY KEY, name text);
CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE, v int);
CREATE TABLE n (id int PRIMARY KEY, p_id int REFERENCES p ON DELETE CASCADE);
"""


def test_verify(spark):
    from docshape.plans import placement

    schema = parse_schema(DDL)[0]
    layouts = layouts_of(schema, placement.plan(schema, placement.features(schema)))
    assert layouts["c"].kind == "array" and layouts["n"].kind == "root"
    report = verify(spark, schema, layouts, ["SELECT p.name, COUNT(c.id) AS k FROM p LEFT JOIN c ON c.p_id = p.id GROUP BY p.name", "DELETE FROM c WHERE v > 500", "INSERT INTO c VALUES (900, 1, 2)", "SELECT 1 UNION SELECT 2", "UPDATE c SET id = 3"], rows=30)
    assert [o.status for o in report.outcomes] == ["MATCH", "NOT_TRANSLATED", "MATCH", "MATCH", "MATCH"] and report.correctness == 1.0


def test_compile(tmp_path, capsys):
    out = compile_schema(DDL, ["SELECT * FROM p RIGHT JOIN c ON c.p_id = p.id"])
    assert ("array", "p", "c") == out["layouts"]["c"] and any(d[1] == "UNSUPPORTED_OUTER_JOIN" for d in out["diagnostics"])
    (tmp_path / "s.sql").write_text(DDL)
    assert cli.main(["compile", str(tmp_path / "s.sql")]) == 0 and "verdicts" in json.loads(capsys.readouterr().out)
    assert cli.main(["version"]) == 0
