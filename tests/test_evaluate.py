"""Verdicts against labels, documents of a layout, transaction blocks."""

import json

from docshape import cli
from docshape.operators import diff, dml
from docshape.operators.reshape import build_layouts, flatten, nest
from docshape.plans import documents, evaluate, guarantees
from docshape.plans.sqlfront import lex, parse_schema, parse_script
from docshape.verify import verify

SHOP = """CREATE TABLE p (id int PRIMARY KEY, code varchar(4) NOT NULL UNIQUE, kind text CONSTRAINT ck_kind CHECK (kind IN ('x', 'y')), n int CHECK (n > -3 AND n <= 9));
CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p ON DELETE CASCADE, tag text UNIQUE, at timestamp DEFAULT now());
CREATE TABLE o (p_id int PRIMARY KEY REFERENCES p, v text NOT NULL UNIQUE);
CREATE TABLE t (id int PRIMARY KEY);
CREATE TABLE j (p_id int REFERENCES p, t_id int REFERENCES t, PRIMARY KEY (p_id, t_id));
CREATE INDEX ix ON c (at);"""
EMBED = ["fk:c.p_id->p.id", "fk:o.p_id->p.id"]


def test_labels_are_met_or_reported(tmp_path, capsys):
    case = tmp_path / "one"
    case.mkdir()
    (case / "schema.sql").write_text(SHOP)
    (case / "queries.sql").write_text("SELECT SUM(n) FROM p; BEGIN; DELETE FROM p; DELETE FROM c; COMMIT; BEGIN; DELETE FROM p; DELETE FROM t; COMMIT; SELECT x FROM nowhere")
    labels = {
        "placements": dict.fromkeys(EMBED, "EMBED") | {"m2n:j": "REF_ARRAY"}, "diagnostics": ["SEM012"], "bulk": [{"match": "pk:*", "status": "SAFE"}, {"match": "none:*", "status": "SAFE"}],
        "verdicts": {n: {"status": v} for n, v in {
            "pk:c.id": "CHANGED", "pk:j.p_id,t_id": "CHANGED", "unique:p.code": "SAFE", "unique:c.tag": "CHANGED", "unique:o.v": "SAFE", "check:p.ck_kind": "SAFE", "check:p.n_3_and_n_9": "SAFE", "default:c.at": "CHANGED",
            "fk:c.p_id->p.id": "SAFE", "cascade_delete:c.p_id->p.id": "SAFE", "fk:o.p_id->p.id": "SAFE", "restrict_delete:o.p_id->p.id": "CHANGED", "fk:j.p_id->p.id": "CHANGED", "restrict_delete:j.p_id->p.id": "CHANGED",
            "fk:j.t_id->t.id": "CHANGED", "restrict_delete:j.t_id->t.id": "CHANGED", "cross_unique:j.p_id,t_id": "BROKEN", "aggregate:q1": "CHANGED", "txn:t1": "SAFE", "txn:t2": "SAFE",
        }.items()},
    }
    (case / "expected.json").write_text(json.dumps(labels))
    m = evaluate.evaluate(evaluate.load_cases(tmp_path))
    assert m.mismatches == [("one", "txn:t2", "SAFE", "CHANGED")] and m.problems == [("one", "pattern without a node", "none:*")]
    assert m.fp == 1 and m.detection == 1.0 and m.exact == m.labels - 1
    assert cli.main(["evaluate", str(tmp_path)]) == 1 and cli.main(["evaluate", str(tmp_path), "--fail-under", "0.9"]) == 0
    assert "severity" in capsys.readouterr().out


def test_options_of_a_case(tmp_path):
    case = evaluate.Case("x", "CREATE TABLE a (id int PRIMARY KEY); CREATE TABLE b (id int PRIMARY KEY); BEGIN; DELETE FROM a; DELETE FROM b; COMMIT", {"options": {"transactions_available": False}})
    assert evaluate.judge(case)[0]["txn:t1"].outcome == "NO_TRANSACTION"
    assert evaluate.evaluate([]).severity == 1.0 and evaluate.load_cases(tmp_path) == []


def _shop():
    s = parse_schema(SHOP)[0]
    return s, build_layouts(s, EMBED, {"j": "p"})


def test_documents_of_a_layout():
    s, layouts = _shop()
    got = {(i.root, i.keys, i.unique) for i in documents.indexes(s, layouts)}
    assert got == {("p", ("code",), True), ("p", ("c.tag",), False), ("p", ("c.at",), False), ("p", ("o.v",), True), ("p", ("t_ids",), False)}
    doc = documents.document_schema(s, layouts, "p")
    assert doc["required"] == ["id", "code"] and not doc["additionalProperties"]
    assert doc["properties"]["code"] == {"type": "string", "maxLength": 4} and doc["properties"]["kind"] == {"type": ["string", "null"], "enum": ["x", "y", None]}
    assert doc["properties"]["n"] == {"type": ["int", "null"], "minimum": -3, "exclusiveMinimum": True, "maximum": 9}
    assert doc["properties"]["c"]["items"]["required"] == ["id"] and doc["properties"]["o"]["type"] == "object" and doc["properties"]["t_ids"] == {"type": "array", "items": {"type": "int"}, "uniqueItems": True}
    plan = documents.migration_plan(s, layouts)
    assert plan["roots"] == ["p", "t"] and plan["tables"]["c"]["implied"] == ["p_id"] and plan["tables"]["o"]["path"] == "o" and json.dumps(plan)
    helpers = guarantees.mitigations(guarantees.verdicts(s, layouts))
    assert "unique:c.tag" in helpers["operators.dml.check_new"] and "restrict_delete:j.t_id->t.id" in helpers["operators.dml.delete_rows"]


def test_a_block_happens_whole_or_not(spark):
    s = parse_schema("CREATE TABLE p (id int PRIMARY KEY, n int); CREATE TABLE c (id int PRIMARY KEY, p_id int NOT NULL REFERENCES p, at timestamp DEFAULT now());")[0]
    tables = {"p": spark.createDataFrame([(1, 5), (2, 6)], "id int, n int"), "c": spark.createDataFrame([(7, 1, None)], "id int, p_id int, at timestamp")}
    good, bad = "BEGIN; INSERT INTO c (id, p_id) VALUES (8, 2); UPDATE p SET n = 0 WHERE id = 2; COMMIT", "BEGIN; DELETE FROM c; INSERT INTO p VALUES (1, 1); DELETE FROM p; COMMIT"
    report = verify(spark, s, build_layouts(s, ["fk:c.p_id->p.id"]), ["SELECT id FROM p ORDER BY id", good, bad, "BEGIN; DELETE FROM c", "SELECT id FROM c"], tables)
    assert [o.status for o in report.outcomes] == ["MATCH", "NOT_TRANSLATED", "MATCH", "MATCH", "MATCH", "SKIPPED"] and [o.rows for o in report.outcomes][3:5] == [2, 0]
    cat = nest(s, build_layouts(s, []), tables)
    q = dml.generated(cat, parse_script("INSERT INTO c (id, p_id) VALUES (9, 1)").items[0][1])
    (at,) = {str(r.at) for _ in range(2) for r in flatten(dml.execute(cat, q), "c").where("id = 9").collect()}
    assert at != "None" and dml.matched(cat, parse_script("DELETE FROM p WHERE n > 5").items[0][1]) == 1


def test_reasons():
    assert "nothing" in diff.hypothesis([(0,)], [], [(0,)], [], one_row=True)
    assert "null" in diff.hypothesis([(1, None)], [(1, 0)], [(1, None)], [(1, 0)]) and "exactness" in diff.hypothesis([(1.5,)], [(1.25,)], [(1.5,)], [(1.25,)])
    assert "numbers of rows" in diff.hypothesis([(1,), (2,)], [(1,)], [(2,)], []) and diff.hypothesis([], [], [], []) == ""


def test_text_of_statements(tmp_path):
    (tmp_path / "q.sql").write_text("SELECT ';' FROM t; -- x;\nBEGIN; DELETE FROM t; COMMIT;\n\n;DELETE FROM t")
    assert [lex(x)[0].text for x in cli.statements(str(tmp_path / "q.sql"))] == ["select", "begin", "delete"]
