"""Registered queries over the benchmark tables, each with the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .model import Layout, Schema
from .operators import checks, diff
from .operators.dml import delete_rows, execute, update_key
from .operators.reshape import Catalog, build_layouts, flatten, nest
from .plans import documents, guarantees, placement
from .plans.query import run_select
from .plans.sqlfront import parse_query, parse_schema, parse_script
from .probes import run_probes
from .sources import datagen
from .sources.tables import children_of, parquet_tables, upsert

DDL = """
CREATE TABLE region (r_regionkey int PRIMARY KEY, r_name text NOT NULL);
CREATE TABLE nation (n_nationkey int PRIMARY KEY, n_name text NOT NULL, n_regionkey int NOT NULL REFERENCES region ON DELETE CASCADE);
CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name text NOT NULL, c_nationkey int NOT NULL REFERENCES nation ON DELETE RESTRICT, c_acctbal double precision, c_mktsegment text);
CREATE TABLE supplier (s_suppkey bigint PRIMARY KEY, s_name text NOT NULL, s_nationkey int REFERENCES nation ON DELETE SET NULL, s_acctbal double precision);
CREATE TABLE part (p_partkey bigint PRIMARY KEY, p_name text, p_brand text, p_type text, p_size int CHECK (p_size BETWEEN 1 AND 50), p_retailprice double precision CHECK (p_retailprice > 0));
CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL REFERENCES customer ON DELETE CASCADE ON UPDATE CASCADE, o_orderstatus text CHECK (o_orderstatus IN ('O', 'F', 'P')), o_totalprice double precision, o_orderdate timestamp, o_orderpriority text);
CREATE TABLE lineitem (l_orderkey bigint NOT NULL REFERENCES orders ON DELETE CASCADE, l_partkey bigint NOT NULL REFERENCES part, l_suppkey bigint NOT NULL REFERENCES supplier, l_linenumber int NOT NULL, l_quantity double precision, l_extendedprice double precision, l_discount double precision, l_tax double precision, l_returnflag text, l_linestatus text, l_shipdate timestamp);
CREATE TABLE events (event_id bigint PRIMARY KEY, ts timestamp, user_id bigint REFERENCES customer (c_custkey), event_type text, value double precision, props text);
CREATE TABLE documents (doc_id bigint PRIMARY KEY, text text, lang text, source text, n_chars bigint);
CREATE TABLE labels (doc_id bigint PRIMARY KEY REFERENCES documents ON DELETE CASCADE, quality int, toxic int);
CREATE TABLE partsupp (ps_partkey bigint REFERENCES part, ps_suppkey bigint REFERENCES supplier, PRIMARY KEY (ps_partkey, ps_suppkey));
"""
_ITEMS, _ORDERS, _NATIONS, _LABELS = "fk:lineitem.l_orderkey->orders.o_orderkey", "fk:orders.o_custkey->customer.c_custkey", "fk:nation.n_regionkey->region.r_regionkey", "fk:labels.doc_id->documents.doc_id"
#: Layouts by name: embedded relationships, folded junctions.
VARIANTS: dict[str, tuple[list[str], dict[str, str]]] = {
    "flat": ([], {}), "items": ([_ITEMS], {}), "deep": ([_ITEMS, _ORDERS], {}), "nations": ([_NATIONS], {}), "labels": ([_LABELS], {}), "folded": ([], {"partsupp": "part"}),
}


@cache
def schema() -> Schema:
    return parse_schema(DDL)[0]


@cache
def layouts(variant: str) -> dict[str, Layout]:
    embed, fold = VARIANTS[variant]
    return build_layouts(schema(), embed, fold)


def catalog(spark: SparkSession, sf_dir: str, variant: str, names: list[str]) -> Catalog:
    """The named tables, nested as the variant says."""
    flat = parquet_tables(spark, sf_dir, [n for n in names if n != "partsupp"])
    if "partsupp" in names:
        items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        flat["partsupp"] = items.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    used = {t: x for t, x in layouts(variant).items() if t in flat}
    return nest(schema(), used, flat)


# name: (layout, SQL), or (layout, SQL, SQL of the oracle where that differs)
SELECTS: dict[str, tuple] = {
    "scan_project": ("flat", "SELECT c_custkey, c_name AS name, c_acctbal FROM customer"),
    "project_star_dedup": ("flat", "SELECT *, n_name FROM nation", "SELECT *, n_name AS n_name_2 FROM nation"),
    "alias_default_names": ("flat", "SELECT c_custkey + 1, count(*) FROM customer GROUP BY c_custkey + 1", "SELECT c_custkey + 1 AS column1, count(*) AS count FROM customer GROUP BY 1"),
    "filter_cmp": ("flat", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'"),
    "filter_bool_ops": ("flat", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000) AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH')"),
    "filter_in": ("flat", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_not_in_null": ("flat", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality NOT IN (1, NULL)"),
    "filter_between": ("flat", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12"),
    "filter_not_between": ("flat", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45"),
    "filter_like": ("flat", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%' OR p_type LIKE '%R_M%'"),
    "filter_ilike": ("flat", "SELECT p_partkey FROM part WHERE p_name ILIKE '%E%' AND p_name NOT ILIKE 'RED%T'"),
    "filter_is_null": ("flat", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.toxic IS NOT NULL AND l.toxic = 1"),
    "filter_cross_column": ("flat", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber * 2"),
    "filter_date_literal": ("flat", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01 00:00:00'"),
    "arith_integer_division": ("flat", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size AS n FROM part", "SELECT p_partkey, p_size // 7 AS q, p_size % 7 AS r, -p_size AS n FROM part"),
    "cast_and_functions": ("flat", "SELECT n_nationkey, UPPER(n_name) AS u, LENGTH(n_name) AS n, CAST(n_nationkey AS bigint) AS b, COALESCE(NULL, n_name) AS c, n_name || '!' AS x FROM nation"),
    "join_inner": ("flat", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000"),
    "join_left": ("flat", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "join_left_where_null": ("flat", "SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey IS NULL"),
    "join_multi_key": ("flat", "SELECT a.l_orderkey, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45"),
    "join_self_alias": ("flat", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey"),
    "join_chain4": ("flat", "SELECT r.r_name, COUNT(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY r.r_name"),
    "join_non_fk": ("flat", "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey WHERE c.c_acctbal > 9000"),
    "nested_join_inner": ("items", "SELECT o.o_orderkey, l.l_partkey, l.l_quantity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O'"),
    "nested_join_left": ("items", "SELECT o.o_orderkey, l.l_orderkey AS k, l.l_partkey FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey"),
    "nested_join_host": ("items", "SELECT l.l_partkey, o.o_orderpriority FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity = 7"),
    "nested_join_foreign_host": ("items", "SELECT p.p_brand, COUNT(*) AS n, ROUND(SUM(l.l_quantity), 2) AS q FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY p.p_brand"),
    "nested_one_to_one_inner": ("labels", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id"),
    "nested_one_to_one_left": ("labels", "SELECT d.doc_id, l.doc_id AS k, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"),
    "nested_two_level": ("deep", "SELECT c.c_mktsegment, COUNT(*) AS n, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment"),
    "nested_embedded_root": ("nations", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_regionkey = r.r_regionkey"),
    "folded_m2n_join": ("folded", "SELECT p.p_partkey, s.s_name FROM part p JOIN partsupp ps ON ps.ps_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = ps.ps_suppkey WHERE p.p_size = 10", "SELECT p.p_partkey, s.s_name FROM part p JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x ON x.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = x.l_suppkey WHERE p.p_size = 10"),
    "unnest_counts": ("items", "SELECT o.o_orderpriority, COUNT(l.l_linenumber) AS n FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderpriority"),
    "agg_count_star": ("flat", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_count_col": ("flat", "SELECT d.lang, COUNT(l.quality) AS n, COUNT(*) AS m FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang"),
    "agg_count_distinct": ("flat", "SELECT l_linestatus, COUNT(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_linestatus"),
    "agg_sum": ("flat", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_sum_distinct": ("flat", "SELECT p_brand, CAST(SUM(DISTINCT p_size) AS bigint) AS s FROM part GROUP BY p_brand"),
    "agg_avg": ("flat", "SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment"),
    "agg_min_max": ("flat", "SELECT o_orderpriority, MIN(o_orderdate) AS first, MAX(o_totalprice) AS most FROM orders GROUP BY o_orderpriority"),
    "agg_global": ("flat", "SELECT COUNT(*) AS n, MIN(p_size) AS low, MAX(p_size) AS high FROM part"),
    "agg_global_empty": ("flat", "SELECT COUNT(*) AS n, MAX(p_size) AS high FROM part WHERE p_size < 0"),
    "agg_sum_left_null": ("flat", "SELECT d.source, CAST(SUM(l.toxic) AS bigint) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source"),
    "agg_group_expr": ("flat", "SELECT p_size / 10 AS decade, COUNT(*) AS n FROM part GROUP BY p_size / 10", "SELECT p_size // 10 AS decade, COUNT(*) AS n FROM part GROUP BY 1"),
    "agg_group_ordinal": ("flat", "SELECT event_type AS kind, COUNT(*) AS n FROM events GROUP BY 1"),
    "agg_having": ("flat", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 14 AND MAX(o_totalprice) > 100"),
    "agg_arith": ("flat", "SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*), 4) AS mean FROM lineitem GROUP BY l_returnflag"),
    "agg_order_hidden": ("flat", "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey"),
    "agg_group_only": ("flat", "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY c_nationkey, c_mktsegment"),
    "distinct_rows": ("flat", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "sort_nulls_pg": ("flat", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC, d.doc_id", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS FIRST, d.doc_id"),
    "sort_nulls_first": ("flat", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY 2 ASC NULLS FIRST, 1 DESC"),
    "topk": ("flat", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_offset": ("flat", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 30"),
}

_TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "partsupp")


def tables_in(sql: str) -> list[str]:
    q = parse_query(sql)
    return [q.source[0], *[j[1] for j in q.joins]]


def _select(name: str) -> Callable[[SparkSession, str], DataFrame]:
    variant, sql = SELECTS[name][:2]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = list(dict.fromkeys(tables_in(sql)))
        used = layouts(variant)
        for n in names:  # a table's rows live with its hosts'
            if used[n].kind != "root" and used[n].host not in names:
                names.append(used[n].host)
        return run_select(catalog(spark, sf_dir, variant, names), sql)

    run.__name__ = name
    return run


def _items_catalog(spark, d, variant="items"):
    return catalog(spark, d, variant, ["orders", "lineitem"] + ["customer"] * (variant == "deep"))


def flatten_roundtrip_orders(spark, d):
    return flatten(_items_catalog(spark, d), "lineitem")


def flatten_two_level(spark, d):
    return flatten(_items_catalog(spark, d, "deep"), "lineitem")


def flatten_one_to_one(spark, d):
    return flatten(catalog(spark, d, "labels", ["documents", "labels"]), "labels")


def flatten_folded(spark, d):
    return flatten(catalog(spark, d, "folded", ["part", "partsupp"]), "partsupp")


def nested_sizes(spark, d):
    docs = _items_catalog(spark, d).roots["orders"]
    return docs.select("o_orderkey", F.coalesce(F.size("lineitem"), F.lit(0)).alias("n"))


def semi_orders_with_items(spark, d):
    t = parquet_tables(spark, d, ["orders", "lineitem"])
    return children_of(t["orders"], ["o_orderkey"], t["lineitem"], ["l_orderkey"]).select("o_orderkey")


def anti_orders_without_items(spark, d):
    t = parquet_tables(spark, d, ["orders", "lineitem"])
    return checks.orphans(t["orders"], ["o_orderkey"], t["lineitem"], ["l_orderkey"]).select("o_orderkey")


def dml_insert_root(spark, d):
    cat = catalog(spark, d, "flat", ["nation"])
    return flatten(execute(cat, "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, 'NOWHERE', 1), (101, 'ELSEWHERE', 2)"), "nation")


def dml_insert_nested(spark, d):
    cat = catalog(spark, d, "nations", ["region", "nation"])
    return flatten(execute(cat, "INSERT INTO nation VALUES (100, 'NOWHERE', 1)"), "nation")


def dml_update_root(spark, d):
    return flatten(execute(catalog(spark, d, "flat", ["part"]), "UPDATE part SET p_size = p_size + 1, p_brand = 'NEW' WHERE p_size > 40"), "part")


def dml_update_nested(spark, d):
    return flatten(execute(_items_catalog(spark, d), "UPDATE lineitem SET l_returnflag = 'X' WHERE l_quantity > 40"), "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")


def dml_update_two_level(spark, d):
    return flatten(execute(_items_catalog(spark, d, "deep"), "UPDATE lineitem SET l_returnflag = 'X' WHERE l_quantity > 40"), "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")


def dml_delete_root(spark, d):
    return flatten(execute(catalog(spark, d, "flat", ["customer"]), "DELETE FROM customer WHERE c_acctbal < 0"), "customer")


def dml_delete_nested(spark, d):
    return flatten(execute(_items_catalog(spark, d), "DELETE FROM lineitem WHERE l_returnflag = 'R'"), "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")


def dml_delete_object(spark, d):
    return flatten(execute(catalog(spark, d, "labels", ["documents", "labels"]), "DELETE FROM labels WHERE toxic = 1"), "labels")


def dml_addtoset(spark, d):
    cat = catalog(spark, d, "folded", ["part", "partsupp"])
    return flatten(execute(cat, "INSERT INTO partsupp VALUES (1, 1), (1, 2)", "INSERT INTO partsupp VALUES (1, 2)"), "partsupp")



def _fk_only(spark, d, *names):
    return parquet_tables(spark, d, list(names))


def fk_cascade_delete(spark, d):
    out = delete_rows(schema(), _fk_only(spark, d, "customer", "orders", "lineitem"), "customer", F.col("c_custkey") % 10 == 3)
    return out["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def fk_set_null(spark, d):
    out = delete_rows(schema(), _fk_only(spark, d, "nation", "supplier"), "nation", F.col("n_nationkey") < 5)
    return out["supplier"].select("s_suppkey", "s_nationkey")


@cache
def _default_schema() -> Schema:
    return parse_schema(DDL.replace("s_nationkey int REFERENCES nation ON DELETE SET NULL", "s_nationkey int DEFAULT 24 REFERENCES nation ON DELETE SET DEFAULT"))[0]


def fk_set_default(spark, d):
    out = delete_rows(_default_schema(), _fk_only(spark, d, "nation", "supplier"), "nation", F.col("n_nationkey") < 5)
    return out["supplier"].select("s_suppkey", "s_nationkey")


def fk_restrict_blockers(spark, d):
    t = _fk_only(spark, d, "nation", "customer")
    return children_of(t["nation"].select("n_nationkey"), ["n_nationkey"], t["customer"], ["c_nationkey"])


def fk_update_cascade(spark, d):
    out = update_key(schema(), _fk_only(spark, d, "customer", "orders"), "customer", "c_custkey", F.col("c_custkey") + 1000000, F.col("c_custkey") % 7 == 0)
    return out["orders"].select("o_orderkey", "o_custkey")


def _violations(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations"))


def check_not_null(spark, d):
    t = parquet_tables(spark, d, ["documents", "labels"])
    return _violations(t["documents"].join(t["labels"], "doc_id", "left").where(F.col("quality").isNull()))


def check_unique(spark, d):
    return checks.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def check_unique_nullable(spark, d):
    t = parquet_tables(spark, d, ["documents", "labels"])
    return checks.duplicate_keys(t["documents"].join(t["labels"], "doc_id", "left"), ["lang", "quality"], nullable=True)


def check_partial_unique(spark, d):
    where = parse_query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'").where
    return checks.duplicate_keys(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey"], where=where)


def check_fk_orphans(spark, d):
    t = parquet_tables(spark, d, ["customer", "events"])
    return _violations(checks.orphans(t["customer"], ["c_custkey"], t["events"], ["user_id"]))


def check_domain(spark, d):
    where = parse_query("SELECT p_size FROM part WHERE p_size BETWEEN 5 AND 45").where
    return _violations(checks.check_violations(spark.read.parquet(f"{d}/part.parquet"), where))


def check_enum(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    return _violations(df.where(~F.col("o_orderstatus").isin("O", "F")))


def check_length(spark, d):
    return _violations(spark.read.parquet(f"{d}/nation.parquet").where(F.char_length("n_name") > 7))


def check_nested_domain(spark, d):
    docs = _items_catalog(spark, d).roots["orders"]
    return checks.element_violations(docs, "lineitem", lambda e: e["l_quantity"] <= 49).select("o_orderkey")


def check_audit(spark, d):
    return checks.audit(schema(), parquet_tables(spark, d, ["region", "nation", "part", "orders", "customer"]))


def fanout_stats(spark, d):
    n = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("parents"), F.max("n").alias("most"), F.sum("n").alias("children"))


def doc_size_stats(spark, d):
    docs = _items_catalog(spark, d).roots["orders"]
    return docs.groupBy(F.coalesce(F.size("lineitem"), F.lit(0)).alias("items")).agg(F.count(F.lit(1)).alias("n"))


def identity_gaps(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet")
    return df.agg((F.max("o_orderkey") - F.min("o_orderkey") + 1 - F.countDistinct("o_orderkey")).alias("gaps"), F.max("o_orderkey").alias("next_after"))


def upsert_rows(spark, d):
    t = spark.read.parquet(f"{d}/nation.parquet")
    new = t.where("n_nationkey < 3").withColumn("n_name", F.lit("CHANGED")).unionByName(t.where("n_nationkey = 0").withColumn("n_nationkey", F.lit(99)))
    return upsert(t, new, ["n_nationkey"])


def diff_multiset(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linenumber")
    return diff.multiset_diff(t, t.where("l_linenumber <> 3").unionByName(t.where("l_linenumber = 1"))).select("side", "n", "l_returnflag", F.col("l_linenumber").cast("long"))


def diff_reals(spark, d):
    """Of prices, a change by a rounding error is none; a change by a cent is one on both sides.

    Rows of equal keys are told apart by their place in the order of prices, which the changes keep: a price that another row
    of its keys had before is a change all the same."""
    place = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("price"))
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price")).withColumn("place", place)
    moved = F.when(F.col("l_linenumber") == 1, F.col("price") + 0.01).when(F.col("l_linenumber") == 2, F.col("price") * (1 + 1e-12)).otherwise(F.col("price"))
    rows = diff.multiset_diff(t, t.withColumn("price", moved)).select("side", "n", F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.round("price", 4).alias("price"))
    return rows.groupBy("side", "l_orderkey", "l_linenumber", "price").agg(F.sum("n").alias("n")).select("side", "n", "l_orderkey", "l_linenumber", "price")


def diff_tolerant(spark, d):
    t = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    moved = t.withColumn("b", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal") * (1 + 1e-12)))
    return moved.where(~diff.values_equal(F.col("c_acctbal"), F.col("b"))).select("c_custkey")


def rule_verdicts(spark, d):
    rows = []
    for variant in VARIANTS:
        rows += [(variant, v.node, v.rule, v.outcome, v.verdict) for v in guarantees.verdicts(schema(), layouts(variant), [parse_query(s[1]) for s in SELECTS.values()])]
    return spark.createDataFrame(rows, "layout string, node string, rule string, outcome string, verdict string")


#: A schema, a workload and layouts in which every rule has every outcome.
RULES_SQL = """CREATE TYPE mood AS ENUM ('up', 'down');
CREATE TABLE p (id bigserial PRIMARY KEY, code varchar(9) NOT NULL UNIQUE, nick text UNIQUE, m mood NOT NULL DEFAULT 'up', d date, n int CHECK (n BETWEEN 0 AND 9), lo int, hi int, born timestamp DEFAULT now(), u uuid DEFAULT gen_random_uuid(),
 CONSTRAINT span CHECK (lo < hi), CONSTRAINT loud CHECK (upper(nick) = nick), CONSTRAINT pc UNIQUE (code, n));
CREATE UNIQUE INDEX ok ON p (n) WHERE n > 0;
CREATE UNIQUE INDEX far ON p (lo) WHERE lower(nick) = 'x';
CREATE TABLE c (id int PRIMARY KEY, p_id bigint NOT NULL REFERENCES p (id) ON DELETE CASCADE ON UPDATE CASCADE, w double precision, k int, UNIQUE (p_id, k));
CREATE TABLE g (id int PRIMARY KEY, c_id int NOT NULL REFERENCES c (id) ON DELETE CASCADE);
CREATE TABLE s (id int PRIMARY KEY, p_code varchar(9) REFERENCES p (code) ON DELETE SET NULL ON UPDATE CASCADE);
CREATE TABLE f (id int PRIMARY KEY, p_id bigint DEFAULT 1 REFERENCES p (id) ON DELETE SET DEFAULT);
CREATE TABLE r (id int PRIMARY KEY, p_id bigint NOT NULL REFERENCES p (id) ON DELETE RESTRICT);
CREATE TABLE t (id int PRIMARY KEY);
CREATE TABLE j (p_id bigint REFERENCES p (id), t_id int REFERENCES t (id), PRIMARY KEY (p_id, t_id));
SELECT p.code FROM p JOIN c ON c.p_id = p.id;
SELECT p.code FROM p LEFT JOIN c ON c.p_id = p.id;
SELECT p.code, c.w FROM p LEFT JOIN c ON c.p_id = p.id;
SELECT COUNT(*) FROM p;
SELECT AVG(n) FROM p;
BEGIN; DELETE FROM c; DELETE FROM p; COMMIT;"""
_RULE_CASES = {
    "flat": ([], {}, True, True), "no transactions": ([], {}, False, False), "child": (["fk:c.p_id->p.id"], {}, True, True), "folded": ([], {"j": "p"}, True, True), "bridge": (["fk:j.p_id->p.id"], {}, True, True),
    "all": (["fk:c.p_id->p.id", "fk:g.c_id->c.id", "fk:s.p_code->p.code", "fk:f.p_id->p.id", "fk:r.p_id->p.id"], {}, True, True),
}


def rule_outcomes(spark, d):
    """Every outcome that every rule has had over the cases, and its verdict."""
    script = parse_script(RULES_SQL)
    found = set()
    for embed, fold, transactions, integer_ids in _RULE_CASES.values():
        where = build_layouts(script.schema, embed, fold, allow_nullable=True)
        found.update((v.rule, v.outcome, v.verdict) for v in guarantees.verdicts(script.schema, where, script.items, transactions, integer_ids))
    return spark.createDataFrame(sorted(found), "rule string, outcome string, verdict string")


def index_plan(spark, d):
    """The indexes that the layout of items in orders in customers asks for."""
    rows = [(i.root, ",".join(i.keys), i.unique, i.origin) for i in documents.indexes(schema(), layouts("deep"))]
    return spark.createDataFrame(rows, "root string, keys string, is_unique boolean, origin string")


def placement_plan(spark, d):
    names = [t for t in schema().tables if t != "partsupp"]
    counts = {t: df.count() for t, df in parquet_tables(spark, d, names).items()}
    feats = placement.features(schema(), [parse_query(s[1]) for s in SELECTS.values()], counts=counts)
    rows = [(x.id, x.decision, x.score, x.host, x.reason) for x in placement.plan(schema(), feats).values()]
    return spark.createDataFrame(rows, "relationship string, decision string, score double, host string, reason string")


def guarantee_probes(spark, d):
    rows = [(p.relationship, p.kind, p.outcome, p.detail) for p in run_probes(catalog(spark, d, "nations", ["region", "nation", "supplier"]))]
    return spark.createDataFrame(rows, "relationship string, kind string, outcome string, detail string")


def seed_rows(spark, d):
    return datagen.generate(spark, schema(), seed=1, rows=200)["orders"]


_OTHERS = [
    flatten_roundtrip_orders, flatten_two_level, flatten_one_to_one, flatten_folded, nested_sizes, semi_orders_with_items, anti_orders_without_items, dml_insert_root, dml_insert_nested, dml_update_root,
    dml_update_nested, dml_update_two_level, dml_delete_root, dml_delete_nested, dml_delete_object, dml_addtoset, fk_cascade_delete, fk_set_null, fk_set_default, fk_restrict_blockers, fk_update_cascade,
    check_not_null, check_unique, check_unique_nullable, check_partial_unique, check_fk_orphans, check_domain, check_enum, check_length, check_nested_domain, check_audit, fanout_stats, doc_size_stats,
    identity_gaps, upsert_rows, diff_multiset, diff_reals, diff_tolerant, rule_verdicts, rule_outcomes, index_plan, placement_plan, guarantee_probes, seed_rows,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _select(n) for n in SELECTS} | {f.__name__: f for f in _OTHERS}

_PAIRS = "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem"
_FLAG = "SELECT l_orderkey, l_quantity, CASE WHEN l_quantity > 40 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem"
_COLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
ORACLE: dict[str, str] = {n: s[-1] for n, s in SELECTS.items()} | {
    "flatten_roundtrip_orders": f"SELECT {_COLS} FROM lineitem", "flatten_two_level": f"SELECT {_COLS} FROM lineitem", "flatten_one_to_one": "SELECT doc_id, quality, toxic FROM labels", "flatten_folded": _PAIRS,
    "nested_sizes": "SELECT o_orderkey, CAST(COUNT(l_orderkey) AS INTEGER) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "semi_orders_with_items": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "anti_orders_without_items": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "dml_insert_root": "SELECT * FROM nation UNION ALL SELECT 100, 'NOWHERE', 1 UNION ALL SELECT 101, 'ELSEWHERE', 2", "dml_insert_nested": "SELECT * FROM nation UNION ALL SELECT 100, 'NOWHERE', 1",
    "dml_update_root": "SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN 'NEW' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_size > 40 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part",
    "dml_update_nested": _FLAG, "dml_update_two_level": _FLAG, "dml_delete_root": "SELECT * FROM customer WHERE NOT c_acctbal < 0",
    "dml_delete_nested": "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'R'", "dml_delete_object": "SELECT doc_id, quality, toxic FROM labels WHERE toxic <> 1",
    "dml_addtoset": f"SELECT * FROM ({_PAIRS}) UNION SELECT 1, 1 UNION SELECT 1, 2",
    "fk_cascade_delete": "SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> 3 GROUP BY l_orderkey",
    "fk_set_null": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier",
    "fk_set_default": "SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 24 ELSE s_nationkey END AS s_nationkey FROM supplier",
    "fk_restrict_blockers": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)",
    "fk_update_cascade": "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders",
    "check_not_null": "SELECT COUNT(*) AS violations FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL",
    "check_unique": "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "check_unique_nullable": "SELECT d.lang, l.quality, COUNT(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "check_partial_unique": "SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R' GROUP BY 1 HAVING COUNT(*) > 1",
    "check_fk_orphans": "SELECT COUNT(*) AS violations FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    "check_domain": "SELECT COUNT(*) AS violations FROM part WHERE p_size NOT BETWEEN 5 AND 45", "check_enum": "SELECT COUNT(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
    "check_length": "SELECT COUNT(*) AS violations FROM nation WHERE length(n_name) > 7", "check_nested_domain": "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49",
    "fanout_stats": "SELECT COUNT(*) AS parents, MAX(n) AS most, CAST(SUM(n) AS BIGINT) AS children FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "doc_size_stats": "SELECT CAST(k AS INTEGER) AS items, COUNT(*) AS n FROM (SELECT COUNT(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) GROUP BY 1",
    "identity_gaps": "SELECT MAX(o_orderkey) - MIN(o_orderkey) + 1 - COUNT(DISTINCT o_orderkey) AS gaps, MAX(o_orderkey) AS next_after FROM orders",
    "upsert_rows": "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'CHANGED' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 99, n_name, n_regionkey FROM nation WHERE n_nationkey = 0",
    "diff_reals": "WITH t AS (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem WHERE l_linenumber = 1) SELECT 'left' AS side, COUNT(*) AS n, l_orderkey, l_linenumber, ROUND(price, 4) AS price FROM t GROUP BY ALL UNION ALL SELECT 'right', COUNT(*), l_orderkey, l_linenumber, ROUND(price + 0.01, 4) FROM t GROUP BY ALL",
    "diff_multiset": "SELECT CASE WHEN l_linenumber = 1 THEN 'right' ELSE 'left' END AS side, COUNT(*) AS n, l_returnflag, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY 1, 3, 4",
    # The outcomes of each rule and their verdicts.
    "rule_outcomes": """SELECT * FROM (VALUES ('EQ-REF-INTEGRITY', 'EMBEDDED', 'SAFE'), ('EQ-REF-INTEGRITY', 'REFERENCED', 'CHANGED'), ('EQ-CASCADE-DEL', 'EMBEDDED', 'SAFE'), ('EQ-CASCADE-DEL', 'REFERENCED', 'BROKEN'), ('EQ-CASCADE-DEL', 'CHAIN', 'BROKEN'),
('EQ-CASCADE-UPD', 'EMBEDDED', 'SAFE'), ('EQ-CASCADE-UPD', 'IMMUTABLE_KEY', 'CHANGED'), ('EQ-CASCADE-UPD', 'MUTABLE_KEY', 'BROKEN'), ('EQ-SET-NULL', 'EMBEDDED', 'CHANGED'), ('EQ-SET-NULL', 'REFERENCED', 'BROKEN'),
('EQ-SET-DEFAULT', 'EMBEDDED', 'CHANGED'), ('EQ-SET-DEFAULT', 'REFERENCED', 'BROKEN'), ('EQ-RESTRICT', 'EMBEDDED', 'CHANGED'), ('EQ-RESTRICT', 'REFERENCED', 'CHANGED'),
('EQ-ENTITY-UNIQ', 'PK_SINGLE', 'SAFE'), ('EQ-ENTITY-UNIQ', 'PK_COMPOSITE', 'SAFE'), ('EQ-ENTITY-UNIQ', 'PK_FOLDED', 'CHANGED'), ('EQ-ENTITY-UNIQ', 'PK_EMBEDDED', 'CHANGED'),
('EQ-VALUE-UNIQ', 'EMBEDDED', 'CHANGED'), ('EQ-VALUE-UNIQ', 'PARTIAL_UNTRANSLATABLE', 'CHANGED'), ('EQ-VALUE-UNIQ', 'NULLABLE', 'CHANGED'), ('EQ-VALUE-UNIQ', 'PARTIAL_OK', 'SAFE'), ('EQ-VALUE-UNIQ', 'UNIQUE_INDEX', 'SAFE'),
('EQ-CROSS-UNIQ', 'OWN_COLLECTION', 'SAFE'), ('EQ-CROSS-UNIQ', 'EMBEDDED', 'CHANGED'), ('EQ-CROSS-UNIQ', 'SPLIT', 'BROKEN'), ('EQ-NOT-NULL', 'VALIDATOR', 'SAFE'),
('EQ-CHECK', 'SAFE_JSONSCHEMA', 'SAFE'), ('EQ-CHECK', 'SAFE_EXPR', 'SAFE'), ('EQ-CHECK', 'UNTRANSLATABLE', 'CHANGED'), ('EQ-TYPE', 'EXACT', 'SAFE'), ('EQ-TYPE', 'LOSSY', 'CHANGED'),
('EQ-DEFAULT', 'CONSTANT', 'CHANGED'), ('EQ-DEFAULT', 'NOW', 'CHANGED'), ('EQ-DEFAULT', 'EXPRESSION', 'CHANGED'), ('EQ-AUTOINC', 'OBJECTID', 'CHANGED'), ('EQ-AUTOINC', 'COUNTER', 'CHANGED'), ('EQ-ENUM', 'ENUM_LIST', 'SAFE'),
('EQ-ATOMIC', 'SINGLE_DOCUMENT', 'SAFE'), ('EQ-ATOMIC', 'TRANSACTION', 'CHANGED'), ('EQ-ATOMIC', 'NO_TRANSACTION', 'BROKEN'), ('EQ-JOIN', 'INNER_EMBEDDED', 'SAFE'), ('EQ-JOIN', 'INNER_REFERENCED', 'SAFE'), ('EQ-JOIN', 'LEFT_CLEAN', 'SAFE'), ('EQ-JOIN', 'LEFT_NULLS', 'CHANGED'),
('EQ-AGG', 'AGG_SAFE', 'SAFE'), ('EQ-AGG', 'AGG_CHANGED', 'CHANGED')) AS r (rule, outcome, verdict)""",
    "index_plan": """SELECT * FROM (VALUES ('partsupp', 'ps_partkey,ps_suppkey', TRUE, 'pk:partsupp'), ('nation', 'n_regionkey', FALSE, 'fk:nation.n_regionkey->region.r_regionkey'), ('customer', 'c_nationkey', FALSE, 'fk:customer.c_nationkey->nation.n_nationkey'),
('supplier', 's_nationkey', FALSE, 'fk:supplier.s_nationkey->nation.n_nationkey'), ('customer', 'orders.lineitem.l_partkey', FALSE, 'fk:lineitem.l_partkey->part.p_partkey'), ('customer', 'orders.lineitem.l_suppkey', FALSE, 'fk:lineitem.l_suppkey->supplier.s_suppkey'),
('events', 'user_id', FALSE, 'fk:events.user_id->customer.c_custkey'), ('partsupp', 'ps_partkey', FALSE, 'fk:partsupp.ps_partkey->part.p_partkey'), ('partsupp', 'ps_suppkey', FALSE, 'fk:partsupp.ps_suppkey->supplier.s_suppkey')) AS i (root, keys, is_unique, origin)""",
    "diff_tolerant": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment over items nested in orders nested in customers."""
    return QUERIES["nested_two_level"](spark, sf_dir).orderBy("c_mktsegment")
