"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, licenses, mixing, packing, pii, quality, simhash_dedup, substring_dedup, token_counts, topk
from .common import read


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(read(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "taken", "array_join(transform(shards_of, x -> concat(x.shard, ':', x.place)), ',') AS drawn")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "digest", "licence", "array_join(line_licences, ',') AS line_licences")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash_dedup, op2_token_counts, op3_best_fit_packing, op4_document_fingerprints, op5_quality, op6_mixing, op7_license_scan, op8_top_k, op9_repeated_substrings, op10_pii)
}


def _canonical(x: str) -> str:
    """``licenses.canonical`` in SQL."""
    lines = f"regexp_replace(lower({x}), '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?:copyright\\b|\\(c\\)|©)[^\\n]*(?:\\n|$)', '', 'g')"
    words = f"trim(regexp_replace(replace({lines}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    # Word by word, phrases after words, unlike the operator's replacing of one spelling after the other.
    single = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in licenses.SPELLINGS if " " not in a) + "}"
    out = f"array_to_string(list_transform(string_split({words}, ' '), lambda w: coalesce(element_at({single}, w)[1], w)), ' ')"
    for a, b in licenses.SPELLINGS:
        if " " in a:
            out = "trim(replace(replace(' ' || replace({}, ' ', '  ') || ' ', ' {} ', ' {} '), '  ', ' '))".format(out, a.replace(" ", "  "), b.replace(" ", "  "))
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)
ORACLE: dict[str, str] = {
    "op7_license_scan": f"""WITH known AS (SELECT sha256({_canonical("t")}) AS d, min(l) AS l FROM (VALUES {_KNOWN}) AS k (l, t) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM docs) WHERE regexp_matches(lower(x), 'licen[cs]e')),
found AS (SELECT r, string_agg(DISTINCT l, ',' ORDER BY l) AS n FROM (SELECT r, sha256({_canonical("x")}) AS d FROM lines) JOIN known USING (d) GROUP BY r)
SELECT doc_id, e.d AS digest, known.l AS licence, coalesce(n, '') AS line_licences FROM (SELECT r, doc_id, sha256({_canonical("t")}) AS d FROM docs) e LEFT JOIN known ON known.d = e.d LEFT JOIN found ON found.r = e.r""",
    "op8_top_k": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda t: t[1] * t[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5""",
}
