"""The corpus pipeline, stage by stage, on the smallest table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0
    by = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in by) <= 4096


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns with names that the stages use."""
    text = lambda i: " ".join(f"w{(i * 7 + k * k) % 89}" for k in range(40))
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [rows[3]] * 40 + [(None, text(100), None, None, None)] * 20 + [(70, None, "en", "s1", 0), (71, "", "en", "s1", 0), (72, "long " * 30_000, "en", None, 5), (73, "7" * 200_000, "en", "s2", 5), (3, text(5), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return docs.withColumns({n: F.lit(k) for k, n in enumerate(["_row", "_order", "_id", "_source", "_size", "_c", "shard", "place", "c0", "none", "masked", "_text", "score", "_at", "node"])})


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_tables(spark, k):
    docs = odd(spark)
    stage = pipeline.STAGES[k][1]
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns
    got, values = out.collect(), [r[c] for c in extra for r in docs.limit(1).collect()]
    assert got and all([r[c] for c in extra] == values for r in got)
    assert stage(spark, docs.limit(0), DATA).count() == 0
    before = Counter(r.text for r in docs.collect())
    if k == 0:  # copies stay or go together
        assert all(n == before[t] for t, n in Counter(r.text for r in got).items())
    if k == 1:  # one row of each text, the smallest id; null and empty texts are alike
        assert Counter(r.text or "" for r in got) == Counter({t or "": 1 for t in before}) and [r.doc_id for r in got].count(3) == 2 and 5 not in {r.doc_id for r in got}
    if k == 2:
        assert len(got) == docs.count() and sum(r.text is None for r in got) == 1
    if k == 3:
        again = stage(spark, docs.repartition(2), DATA).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_packing_stage_on_odd_tables(spark):
    docs = odd(spark)
    out = pipeline.STAGES[4][1](spark, docs, DATA)
    assert out.select("doc_id", "start").where("start = 0").count() == docs.count() and pipeline.STAGES[4][1](spark, docs.limit(0), DATA).count() == 0


def test_registered(spark):
    import __spark_entry__ as e

    assert [n for n in e.queries() if n.startswith("op")] == [n for n in e.queries() if n.split("_")[0] in {f"op{i}" for i in range(1, 11)}] and "pipeline" in e.queries()
