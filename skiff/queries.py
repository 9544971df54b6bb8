"""Registered queries over the tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff.functions import collections as lists
from skiff.functions import dates, numeric, text, urls
from skiff.operators import scoring, workloads
from skiff.operators.arrays import Grid
from skiff.operators.frame import Frame
from skiff.plans.values import choose
from skiff.session import load
from skiff.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LINE = [("l_orderkey", True), ("l_linenumber", True), ("l_partkey", True), ("l_suppkey", True), ("l_quantity", True), ("l_extendedprice", True)]
ORDER = [("o_orderkey", True)]


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def frame(spark: SparkSession, d: str, name: str, order=(), index=()) -> Frame:
    return Frame(load(spark, d, name), index, order)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def scan_project(spark, d):
    return io.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("SELECT l_extendedprice * (1 - l_discount) AS disc_price FROM lineitem")
def udf_scan(spark, d):
    return io.udf_scan(spark, f"{d}/lineitem.parquet", ["l_extendedprice", "l_discount"], "disc_price", lambda p, x: p * (1 - x))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def select_columns(spark, d):
    return frame(spark, d, "orders")[["o_orderkey", "o_orderstatus", "o_totalprice"]].df


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10")
def filter_mask(spark, d):
    f = frame(spark, d, "lineitem")
    return f[f["l_quantity"] < 10][["l_orderkey", "l_linenumber", "l_quantity"]].df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 10 OR l_discount >= 0.05) AND NOT l_returnflag = 'R'")
def filter_bool_ops(spark, d):
    f = frame(spark, d, "lineitem")
    return f[((f["l_quantity"] < 10) | (f["l_discount"] >= 0.05)) & ~(f["l_returnflag"] == "R")][["l_orderkey", "l_linenumber"]].df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_tax > 2 AND l_linestatus = 'O'")
def filter_by_function(spark, d):
    return frame(spark, d, "lineitem").filter_by(lambda r: (r["l_quantity"] * r["l_tax"] > 2) & (r["l_linestatus"] == "O"))[["l_orderkey", "l_linenumber"]].df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def set_column_arith(spark, d):
    f = frame(spark, d, "lineitem")
    f["charge"] = f.apply(lambda r: r["l_extendedprice"] * (1 - r["l_discount"]) * (1 + r["l_tax"]), axis=1)
    return f.df.select("l_orderkey", "l_linenumber", "charge")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity - l_tax + 3 AS v FROM lineitem")
def series_arith(spark, d):
    f = frame(spark, d, "lineitem")
    s = f["l_extendedprice"].div(f["l_quantity"]).sub(f["l_tax"]).add(3.0)
    return f.assign(v=s).df.select("l_orderkey", "l_linenumber", "v")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS before, l_quantity * 2 AS after FROM lineitem")
def column_versions(spark, d):
    f = frame(spark, d, "lineitem")
    old = f["l_quantity"]
    f["after"] = f["l_quantity"] * 2
    f["before"] = old
    return f.df.select("l_orderkey", "l_linenumber", "before", "after")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'big' ELSE 'small' END AS size FROM lineitem")
def apply_scalar(spark, d):
    f = frame(spark, d, "lineitem")
    return f.assign(size=f["l_quantity"].apply(lambda q: choose(q > 30, "big", "small"), strict=True)).df.select("l_orderkey", "l_linenumber", "size")


def _shout(s) -> str:
    return s.title() + "!" if len(s) > 5 else s


@query("SELECT o_orderkey, CASE WHEN length(o_orderpriority) > 5 THEN upper(o_orderpriority[1:1]) || o_orderpriority[2:] || '!' ELSE o_orderpriority END AS p FROM (SELECT o_orderkey, lower(o_orderstatus) || 'abcdef' AS o_orderpriority FROM orders)")
def apply_arrow_fallback(spark, d):
    f = Frame(load(spark, d, "orders").select("o_orderkey", F.concat(F.lower("o_orderstatus"), F.lit("abcdef")).alias("s")))
    return f.assign(p=f["s"].apply(_shout)).df.select("o_orderkey", "p")


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS v FROM lineitem")
def element_wise(spark, d):
    f = frame(spark, d, "lineitem")
    return f.assign(v=f["l_quantity"].element_wise(f["l_discount"], lambda a, b: a * b)).df.select("l_orderkey", "l_linenumber", "v")


@query("""SELECT o_orderkey, o_orderstatus || '_' || CAST(o_custkey AS VARCHAR) AS tag FROM orders""")
def apply_rowwise(spark, d):
    g = Frame(load(spark, d, "orders").withColumn("key", F.col("o_custkey").cast("string")))
    return g.assign(tag=g.apply(lambda r: r["o_orderstatus"] + "_" + r["key"], axis=1)).df.select("o_orderkey", "tag")


@query("SELECT l_quantity + 1 AS l_quantity, l_tax + 1 AS l_tax FROM lineitem")
def apply_columnwise(spark, d):
    return frame(spark, d, "lineitem")[["l_quantity", "l_tax"]].apply(lambda s: s + 1.0, axis=0).df


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_quantity + l_tax AS b FROM lineitem")
def compute_many(spark, d):
    return frame(spark, d, "lineitem").compute(a=lambda r: r["l_quantity"] * 2, b=lambda r: r["l_quantity"] + r["l_tax"]).df.select("l_orderkey", "l_linenumber", "a", "b")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 0.0 ELSE l_extendedprice END AS v FROM lineitem")
def mask_where(spark, d):
    f = frame(spark, d, "lineitem")
    return f.assign(v=f["l_extendedprice"].mask(f["l_discount"] > 0.05, 0.0)).df.select("l_orderkey", "l_linenumber", "v")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN -1.0 ELSE l_discount END AS v FROM lineitem")
def fillna_frame(spark, d):
    f = frame(spark, d, "lineitem")
    f["v"] = f["l_discount"].mask(f["l_discount"] > 0.05, float("nan"))
    return f[["l_orderkey", "l_linenumber", "v"]].fillna(-1.0).df


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS n FROM orders")
def add_index_column(spark, d):
    return frame(spark, d, "orders", ORDER).add_index_column("n").df.select("o_orderkey", "n")


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS BIGINT) AS index, o_orderkey AS level_0, o_totalprice FROM orders")
def reset_index(spark, d):
    f = Frame(load(spark, d, "orders").select(F.col("o_orderkey").alias("index"), "o_totalprice"), ("index",), [("index", True)])
    return f.sort_values("o_totalprice", ascending=False).reset_index().df


@query("SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS owing FROM orders")
def isin_column(spark, d):
    f, c = frame(spark, d, "orders"), frame(spark, d, "customer")
    s = f["o_custkey"].isin(c[c["c_acctbal"] < 0]["c_custkey"])
    return s.frame.df.select("o_orderkey", s.col.alias("owing"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def unique(spark, d):
    return frame(spark, d, "customer")["c_mktsegment"].unique()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_slice(spark, d):
    return frame(spark, d, "orders", ORDER).sort_values("o_totalprice", False)[10:30].df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15")
def sort_tail_slice(spark, d):
    return frame(spark, d, "orders").sort_values(["o_totalprice", "o_orderkey"])[-15:].df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS c FROM orders) WHERE n > 5 AND n <= c - 7")
def sort_middle_slice(spark, d):
    return frame(spark, d, "orders", ORDER)[5:-7].df.select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def topk(spark, d):
    return frame(spark, d, "lineitem", LINE).sort_values("l_extendedprice", False)[:10].df.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 7")
def iloc_row(spark, d):
    return frame(spark, d, "orders", ORDER).iloc[7].df.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def label_lookup(spark, d):
    return frame(spark, d, "customer", index=("c_name",)).at_label("Customer#000000007").df.select("c_custkey", "c_name")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def row_count(spark, d):
    return frame(spark, d, "lineitem").df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_left_on_right_on(spark, d):
    return frame(spark, d, "orders").merge(frame(spark, d, "customer"), left_on="o_custkey", right_on="c_custkey").df.select("o_orderkey", "c_name")


@query("SELECT n_nationkey AS k, n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def join_inner(spark, d):
    n, s = load(spark, d, "nation").withColumnRenamed("n_nationkey", "k"), load(spark, d, "supplier").withColumnRenamed("s_nationkey", "k")
    return Frame(n).merge(Frame(s), on="k").df.select("k", "n_name", "s_name")


@query("SELECT a.l_partkey, a.l_suppkey, q, p FROM (SELECT l_partkey, l_suppkey, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(spark, d):
    f = frame(spark, d, "lineitem")
    a = f.groupby(["l_partkey", "l_suppkey"]).agg(q=("l_quantity", "min"))
    b = f[f["l_returnflag"] == "R"].groupby(["l_partkey", "l_suppkey"]).agg(p=("l_extendedprice", "min"))
    return a.merge(b, on=["l_partkey", "l_suppkey"]).df


@query("SELECT c_custkey AS k, c_name, n FROM customer JOIN (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_index(spark, d):
    c = Frame(load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), ("k",))
    o = Frame(load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), ("k",))
    return c.merge(o, left_index=True, right_index=True).df


@query("SELECT c_custkey, coalesce(o_totalprice, CAST('nan' AS DOUBLE)) AS o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_nan(spark, d):
    o = frame(spark, d, "orders")[["o_custkey", "o_totalprice"]]
    return frame(spark, d, "customer").merge(o, how="left", left_on="c_custkey", right_on="o_custkey").df.select("c_custkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_extendedprice * (1 - l_discount)) AS least, round(avg(l_quantity), 6) AS quantity FROM lineitem WHERE l_quantity < 24 GROUP BY 1, 2")
def groupby_sum_min_mean(spark, d):
    f = frame(spark, d, "lineitem")
    f["disc_price"] = f.apply(lambda r: r["l_extendedprice"] * (1 - r["l_discount"]), axis=1)
    g = f[f["l_quantity"] < 24].groupby(["l_returnflag", "l_linestatus"]).agg(revenue=("disc_price", "sum"), least=("disc_price", "min"), quantity=("l_quantity", "mean"))
    return g.df.select("l_returnflag", "l_linestatus", F.round("revenue", 2).alias("revenue"), "least", F.round("quantity", 6).alias("quantity"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, min(o_totalprice) AS least FROM orders GROUP BY 1")
def groupby_named(spark, d):
    g = frame(spark, d, "orders").groupby("o_custkey").agg(spent=("o_totalprice", "sum"), least=("o_totalprice", "min"))
    return g.df.select("o_custkey", F.round("spent", 2).alias("spent"), "least")


@query("SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS l_suppkey FROM lineitem GROUP BY 1")
def groupby_nunique(spark, d):
    return frame(spark, d, "lineitem").groupby(["l_returnflag"])["l_suppkey"].nunique().df


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def group_distinct(spark, d):
    return frame(spark, d, "lineitem").groupby(["l_returnflag", "l_linestatus"]).agg({}).df


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem")
def series_sum(spark, d):
    return frame(spark, d, "lineitem")["l_linenumber"].sum()


@query("SELECT string_agg(s_name, '' ORDER BY s_suppkey) AS sum FROM supplier")
def series_sum_string(spark, d):
    return frame(spark, d, "supplier", [("s_suppkey", True)])["s_name"].sum()


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS flags FROM lineitem GROUP BY 1")
def group_sum_string(spark, d):
    f = frame(spark, d, "lineitem")
    f["flags"] = f["l_returnflag"] + f["l_linestatus"]
    return f.groupby("l_orderkey")["flags"].join_text("l_linenumber").df


@query("SELECT vec_id, list_sum(list_transform(list_zip(embedding[1:4], embedding[5:8]), lambda p: CAST(p[1] < p[2] AS INTEGER))) > 0 AND list_sum(list_transform(list_zip(embedding[1:4], embedding[5:8]), lambda p: CAST(p[1] > p[2] AS INTEGER))) = 0 AS less FROM embeddings")
def list_less(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", lists.less(lists.cut(e, 0, 4), lists.cut(e, 4, 8)).alias("less"))


@query("SELECT o_orderkey, '[' || o_custkey || ', ' || o_shippriority || ']' AS l, '{' || chr(39) || o_orderstatus || chr(39) || ': ' || o_custkey || '}' AS m FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 3 AS o_shippriority FROM orders)")
def container_text(spark, d):
    shown = lambda c: c.cast("string")
    pair = F.array(F.col("o_custkey"), F.col("o_orderkey") % 3)
    return load(spark, d, "orders").select("o_orderkey", lists.list_text(pair, shown).alias("l"), lists.dict_text(F.create_map("o_orderstatus", "o_custkey"), lists.quoted, shown).alias("m"))


@query("SELECT l_orderkey, l_linenumber, 3.0::DOUBLE + l_quantity * 1 + l_tax * 2 AS y FROM lineitem")
def stored_model_score(spark, d):
    m = scoring.from_json('{"model": "LinearRegression", "coef": [1.0, 2.0], "intercept": 3.0}')
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.predict([F.col("l_quantity"), F.col("l_tax")]).alias("y"))


@query("SELECT user_id, round(sum(value * value), 2) AS squares FROM events GROUP BY 1")
def custom_aggregate(spark, d):
    g = frame(spark, d, "events", [("event_id", True)]).groupby("user_id")["value"]
    return g.aggregate(0.0, lambda s, v: s + v * v, combine=lambda a, b: a + b).select("user_id", F.round("value", 2).alias("squares"))


@query("SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings")
def list_sum_min_max(spark, d):
    e = load(spark, d, "embeddings")
    return e.select("vec_id", F.round(lists.total(F.col("embedding").cast("array<double>")), 4).alias("total"), F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"))


@query("SELECT round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stdev, round(var_samp(value), 3) AS variance FROM events")
def stats_mean_stdev(spark, d):
    s = frame(spark, d, "events")["value"]
    parts = [s.mean(), s.stdev(), s.stdev(variance_parity=True).withColumnRenamed("stdev", "variance")]
    one = [p.withColumn("_one", F.lit(1)) for p in parts]  # a row each
    out = one[0].join(one[1], "_one").join(one[2], "_one")
    return out.select(F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), F.round("variance", 3).alias("variance"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey - 500) // 7 AS q, (l_partkey - 500) % 7 AS r, CAST(floor((l_partkey - 500) / 7) AS BIGINT) AS fq, ((l_partkey - 500) % 7 + 7) % 7 AS fr FROM lineitem")
def int_ops(spark, d):
    x = F.col("l_partkey") - 500
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.int_div(x, 7).alias("q"), numeric.remainder(x, 7).alias("r"), numeric.floor_div(x, 7).alias("fq"), numeric.python_mod(x, 7).alias("fr"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) ELSE l_quantity / l_discount END AS d, l_tax * l_tax AS p, l_quantity % 4 AS m FROM lineitem")
def float_ops(spark, d):
    # The SQL takes every quantity without a discount as infinite, also 0, negative ones and NULL.
    q = F.when(F.col("l_discount") == 0, numeric.INF).otherwise(numeric.float_div(F.col("l_quantity"), F.col("l_discount")))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("d"), numeric.power(F.col("l_tax"), 2).alias("p"), (F.col("l_quantity") % 4).alias("m"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, round(ln(l_extendedprice), 6) AS b, round(exp(l_tax), 6) AS c, round(sin(l_quantity), 6) AS s, round(cos(l_quantity), 6) AS o, round(asin(l_discount), 6) AS i, abs(l_discount - 0.05) AS ab FROM lineitem")
def math_funcs(spark, d):
    r = lambda c, n: F.round(c, 6).alias(n)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(numeric.sqrt("l_quantity"), "a"), r(numeric.log(F.col("l_extendedprice")), "b"), r(numeric.exp("l_tax"), "c"), r(numeric.sin("l_quantity"), "s"), r(numeric.cos("l_quantity"), "o"), r(numeric.arcsin("l_discount"), "i"), numeric.absolute(F.col("l_discount") - 0.05).alias("ab"))


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CAST(l_partkey AS DOUBLE) AS f, TRY_CAST(l_returnflag AS BIGINT) AS bad, CAST(l_quantity > 25 AS BIGINT) AS b, CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END AS t, CAST(l_partkey AS VARCHAR) AS s FROM lineitem")
def casts(spark, d):
    c = F.col
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_extendedprice").cast("bigint").alias("i"), c("l_partkey").cast("double").alias("f"), numeric.to_int(c("l_returnflag")).alias("bad"), (c("l_quantity") > 25).cast("bigint").alias("b"), numeric.bool_text(c("l_quantity") > 25).alias("t"), c("l_partkey").cast("string").alias("s"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -1 END AS v FROM orders")
def try_or_default(spark, d):
    raw = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("x")
    return load(spark, d, "orders").select("o_orderkey", lists.try_or(numeric.to_int(raw), -1).alias("v"))


@query("SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, contains(p_name, 'an') AS h, ascii(p_name[1:1]) AS o FROM part")
def str_case_len_contains(spark, d):
    f = frame(spark, d, "part")
    s = f["p_name"].str
    return f.assign(l=s.lower(), u=s.upper(), n=s.len(), h=s.contains("an")).df.select("p_partkey", "l", "u", F.col("n").cast("bigint").alias("n"), "h", text.code(F.col("p_name")).alias("o"))


@query("SELECT p_partkey, strpos(p_name, 'a') - 1 AS f, CASE WHEN strpos(p_name, 'a') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'a') END AS r FROM part")
def str_find_rfind(spark, d):
    c = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", text.find(c, "a").cast("bigint").alias("f"), text.rfind(c, "a").cast("bigint").alias("r"))


@query("SELECT doc_id, replace(text, 'the', '<>') AS t FROM documents")
def str_replace(spark, d):
    return load(spark, d, "documents").select("doc_id", text.replace(F.col("text"), "the", "<>").alias("t"))


@query("SELECT p_partkey, p_name[1:3] AS a, p_name[3:] AS b, p_name[-3:] AS c FROM part")
def str_slice(spark, d):
    c = F.col("p_name")
    return load(spark, d, "part").select("p_partkey", text.slice_(c, 0, 3).alias("a"), text.slice_(c, 2).alias("b"), text.slice_(c, -3).alias("c"))


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n, array_to_string(string_split(text, ' ')[1:3], '-') AS head FROM documents")
def str_split_join(spark, d):
    words = text.split(F.col("text"), " ")
    return load(spark, d, "documents").select("doc_id", F.size(words).cast("bigint").alias("n"), text.join(lists.cut(words, 0, 3), "-").alias("head"))


@query("SELECT o_orderkey, CASE WHEN contains(s, '-') THEN string_split(s, '-')[1] ELSE s END AS head, CASE WHEN contains(s, '-') THEN '-' ELSE '' END AS sep, CASE WHEN contains(s, '-') THEN s[strpos(s, '-') + 1:] ELSE '' END AS tail FROM (SELECT o_orderkey, o_orderpriority AS s FROM orders)")
def str_partition(spark, d):
    return load(spark, d, "orders").select("o_orderkey", text.partition(F.col("o_orderpriority"), "-").alias("p")).select("o_orderkey", "p.*")


@query("SELECT c_custkey, c_name AS t FROM customer")
def str_strip(spark, d):
    return load(spark, d, "customer").select("c_custkey", text.strip(F.concat(F.lit(" \t\n"), F.col("c_name"), F.lit("\r\n "))).alias("t"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^(?:([^:/?#]+):)?', 1)) AS scheme, regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1) AS netloc,
    regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_split(spark, d):
    return load(spark, d, "pages").select("page_id", urls.urlsplit(F.col("url")).alias("u")).select("page_id", "u.*")


@query(r"""SELECT page_id, nullif(regexp_extract(url, '^[^:/?#]+://(?:[^@/]*@)?([^:/?#]+)', 1), '') AS hostname, TRY_CAST(nullif(regexp_extract(url, '^[^:/?#]+://[^/?#]*:([0-9]+)(?:[/?#]|$)', 1), '') AS BIGINT) AS port FROM pages""")
def url_netloc(spark, d):
    return load(spark, d, "pages").select("page_id", urls.netloc_parts(urls.urlsplit(F.col("url"))["netloc"]).alias("u")).select("page_id", "u.hostname", "u.port")


@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(hour(ts) AS BIGINT) AS h FROM events")
def to_datetime_parts(spark, d):
    f = Frame(load(spark, d, "events").withColumn("s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    t = f["s"].to_datetime()
    return f.assign(y=t.dt.year, h=t.dt.hour).df.select("event_id", F.col("y").cast("bigint").alias("y"), F.col("h").cast("bigint").alias("h"))


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, o_orderdate + INTERVAL 2 MONTH AS later, CAST(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS s FROM orders")
def date_arith(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select("o_orderkey", dates.month(t).cast("bigint").alias("m"), dates.day(t).cast("bigint").alias("d"), dates.add_months(t, 2).alias("later"), dates.seconds_between(F.lit("1992-01-01").cast("timestamp_ntz"), t).alias("s"))


@query("SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0), lambda x: x * 2)), 4) AS pos FROM embeddings")
def list_ops(spark, d):
    e = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select("vec_id", lists.item(F.col("embedding"), 0).alias("first"), lists.item(F.col("embedding"), -1).alias("last"), F.size(e).cast("bigint").alias("n"), F.round(lists.total(lists.comprehension(e, lambda x: x * 2, lambda x: x > 0)), 4).alias("pos"))


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def dict_grouping(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, min(turn) AS first, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def struct_ops(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), pairs[0]["turn"].alias("first"), F.array_join(F.transform(pairs, lambda p: p["role"]), ",").alias("roles"))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x + 2 * x)), 3) AS s FROM embeddings")
def array_elementwise(spark, d):
    e = F.col("embedding").cast("array<double>")
    return load(spark, d, "embeddings").select("vec_id", F.round(lists.total(lists.elementwise(lists.elementwise(e, e, lambda a, b: a * b), lists.elementwise(e, 2.0, lambda a, b: a * b), lambda a, b: a + b)), 3).alias("s"))


@query("SELECT vec_id, embedding[2:11] AS part, embedding[9:16] AS row1 FROM embeddings")
def array_slice_reshape(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", lists.cut(e, 1, 11).alias("part"), lists.reshape(e, 8, 8)[1].alias("row1"))


@query("SELECT l_orderkey, l_linenumber, 3.0::DOUBLE + l_quantity * 1 + l_tax * 2 AS y FROM lineitem")
def lin_score(spark, d):
    m = scoring.LinearRegression([1.0, 2.0], 3.0)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.predict([F.col("l_quantity"), F.col("l_tax")]).alias("y"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN -1 + 0.04 * l_quantity - 5 * l_discount > 0 THEN 1 ELSE 0 END AS c FROM lineitem")
def logit_score(spark, d):
    m = scoring.LogisticRegression([[0.04, -5.0]], [-1.0])
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.predict([F.col("l_quantity"), F.col("l_discount")]).alias("c"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity - 10) * (l_quantity - 10) <= (l_quantity - 25) * (l_quantity - 25) AND (l_quantity - 10) * (l_quantity - 10) <= (l_quantity - 40) * (l_quantity - 40) THEN 0 WHEN (l_quantity - 25) * (l_quantity - 25) <= (l_quantity - 40) * (l_quantity - 40) THEN 1 ELSE 2 END AS c FROM lineitem")
def kmeans_assign(spark, d):
    m = scoring.KMeans([[10.0], [25.0], [40.0]])
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.predict([F.col("l_quantity")]).alias("c"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity - 1) * 0.02::DOUBLE AS x FROM lineitem")
def minmax_scale(spark, d):
    m = scoring.MinMaxScaler([1.0], [0.02])
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.transform([F.col("l_quantity")])[0].alias("x"))


@query("SELECT l_orderkey, l_linenumber, 0.5::DOUBLE + (l_quantity - 1) * 0.02::DOUBLE * 3 AS y FROM lineitem")
def pipeline_score(spark, d):
    m = scoring.Pipeline([scoring.MinMaxScaler([1.0], [0.02]), scoring.LinearRegression([3.0], 0.5)])
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.predict([F.col("l_quantity")]).alias("y"))


@query("""WITH r AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(1000 + p_size AS BIGINT) AS sqft, CAST(round(p_retailprice) AS BIGINT) * (80 + 6 * p_size) AS asked,
        p_partkey % 11 <> 0 AS told, p_partkey % 5 AS k FROM part),
    p AS (SELECT *, CASE k WHEN 0 THEN 'sale' WHEN 1 THEN 'rent' WHEN 2 THEN 'sold' WHEN 3 THEN 'foreclosed' ELSE 'House by the Lake' END AS offer, CASE WHEN k = 2 THEN (90 + 2 * size) * sqft WHEN told THEN asked END AS price FROM r)
    SELECT p_partkey, size AS bedrooms, CAST(p_partkey % 4 AS BIGINT) AS bathrooms, sqft, offer, CAST(price AS BIGINT) AS price FROM p WHERE size < 10 AND p_partkey % 7 <> 0 AND price > 100000 AND price < 20000000""")
def wl_clean_listings(spark, d):
    def commas(number):
        return F.format_number(number, 0)

    key, size = F.col("p_partkey"), F.col("p_size")
    asked = F.round("p_retailprice").cast("bigint") * (80 + 6 * size)
    facts = F.concat(size.cast("string"), F.lit(" bds , "), (key % 4).cast("string"), F.lit(" ba , "), commas(size + 1000), F.lit(" sqft"), F.lit(", Price/sqft: $"), (90 + 2 * size).cast("string"))
    kind = F.when(key % 7 == 0, "Condo").otherwise("House")  # condos are left out, as are numbers that cannot be read
    title = F.when(key % 5 == 0, F.concat(kind, F.lit(" For Sale"))).when(key % 5 == 1, F.concat(kind, F.lit(" For Rent"))).when(key % 5 == 2, F.concat(F.lit("SOLD: "), kind)).when(key % 5 == 3, F.concat(F.lit("Foreclosed "), kind)).otherwise(F.concat(kind, F.lit(" by the Lake")))
    raw = load(spark, d, "part").select(
        facts.alias("facts and features"), title.alias("title"), F.when(key % 11 != 0, F.concat(F.lit("$"), commas(asked))).otherwise("on request").alias("price"), F.lit("10001").alias("postal_code"),
        F.col("p_brand").alias("city"), F.lit("NY").alias("state"), key.cast("string").alias("url"), F.lit("").alias("address"),
    )
    return workloads.clean_listings(raw).select(F.col("url").cast("bigint").alias("p_partkey"), "bedrooms", "bathrooms", "sqft", "offer", "price")


@query("SELECT page_id, '/p' || CAST(page_id AS VARCHAR) AS endpoint, 'GET' AS method, 'HTTP/1.1' AS protocol, CAST(200 + page_id % 5 AS BIGINT) AS response_code, CAST(strlen(html) AS BIGINT) AS content_size, '01/Jan/2020:00:00:00 +0000' AS date FROM pages")
def wl_logs(spark, d):
    line = F.concat_ws(" ", F.col("page_id").cast("string"), F.lit("- - [01/Jan/2020:00:00:00 +0000] \"GET"), F.concat(F.lit("/p"), F.col("page_id").cast("string")), F.lit('HTTP/1.1"'), (200 + F.col("page_id") % 5).cast("string"), F.octet_length("html").cast("string"))
    out = workloads.parse_logs(load(spark, d, "pages").select(line.alias("line")))
    return out.select(F.col("ip").cast("bigint").alias("page_id"), "endpoint", "method", "protocol", "response_code", "content_size", "date")


@query("SELECT round(sum(CASE WHEN v > 0.02 THEN 0.032 WHEN v < 0.01 THEN 0.005 ELSE v END), 4) AS total FROM (SELECT (l_quantity * 2 + CASE WHEN l_extendedprice > 500000 THEN 0 ELSE l_extendedprice END - l_linenumber * 2000) / 100000 AS v FROM lineitem)")
def wl_crime_index(spark, d):
    df = load(spark, d, "lineitem")
    return df.agg(F.round(F.sum(workloads.crime_index(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber"))), 4).alias("total"))


@query("""WITH RECURSIVE t AS (SELECT event_type AS symbol, date_trunc('second', ts) AS second, CAST(sum(CAST(trunc(value) AS BIGINT)) AS DOUBLE) AS x FROM events GROUP BY 1, 2),
    n AS MATERIALIZED (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY second) AS k, x FROM t),
    s AS (SELECT symbol, 0 AS k, CAST([] AS DOUBLE[]) AS w, 0.0::DOUBLE AS center, 0.0::DOUBLE AS spread, 0 AS total FROM (SELECT DISTINCT symbol FROM n)
        UNION ALL SELECT s.symbol, s.k + 1,
            CASE WHEN len(w) < 100 THEN list_append(w, x) ELSE list_append(w[2:], CASE WHEN abs(x - center) > 10 * spread THEN 0.5 * x + 0.5 * w[-1] ELSE x END) END,
            CASE WHEN len(w) < 100 THEN 0 ELSE list_sum(w) / 100 END, CASE WHEN len(w) < 100 THEN 0 ELSE list_var_samp(w) END,
            total + CASE WHEN len(w) < 100 OR abs(x - center) <= 10 * spread THEN 0 WHEN x > center THEN 1 ELSE -1 END
        FROM s JOIN n ON n.symbol = s.symbol AND n.k = s.k + 1)
    SELECT symbol, CAST(max_by(total, k) AS BIGINT) AS peaks FROM s GROUP BY 1""")
def wl_ticks(spark, d):
    return workloads.tick_peaks(load(spark, d, "events"), "event_type", F.col("ts"), F.col("value").cast("bigint"))


@query("SELECT event_type AS symbol, date_trunc('second', ts) AS second, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")
def ticks_by_second(spark, d):
    from skiff.streaming.ticks import volume_by_second

    out = volume_by_second(load(spark, d, "events"), "event_type", "ts", "value")
    return out.select("symbol", F.col("second").cast("timestamp_ntz").alias("second"), F.round("v", 4).alias("v"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS n FROM part")
def wl_levenshtein(spark, d):
    return load(spark, d, "part").select("p_partkey", text.levenshtein("p_name", "p_type").cast("bigint").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(2 * 3959.0 * asin(sqrt(pow(sin((l_tax - 0.70984286) / 2), 2) + cos(0.70984286) * cos(l_tax) * pow(sin((l_discount - 1.2389197) / 2), 2))), 4) AS miles FROM lineitem")
def wl_haversine(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(workloads.haversine(F.col("l_tax"), F.col("l_discount")), 4).alias("miles"))


#: erf in SQL by another way: exp(-x^2) times the sum of x^(2n+1) / gamma(n + 3/2), all terms of one sign.
_ERF = "CASE WHEN abs(x) >= 6 THEN sign(x) ELSE sign(x) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest(abs(x), 1e-300)) - x * x - lgamma(n + 1.5)))) END"


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS price, l_tax AS rate, l_discount + 0.1 AS vol FROM lineitem),
    d AS (SELECT *, (ln(price / 25.0::DOUBLE) + (rate + vol * vol / 2)) / vol AS d1 FROM o),
    n AS (SELECT *, {_ERF.replace('x', '(d1 / sqrt(2.0))').replace('e(d1 / sqrt(2.0))p', 'exp')} AS e1, {_ERF.replace('x', '((d1 - vol) / sqrt(2.0))').replace('e((d1 - vol) / sqrt(2.0))p', 'exp')} AS e2 FROM d),
    c AS (SELECT *, price * (e1 + 1) / 2 - 25.0::DOUBLE * exp(-rate) * (e2 + 1) / 2 AS call FROM n)
    SELECT l_orderkey, l_linenumber, round(call, 6) + 0.0 AS call, round(25.0::DOUBLE * exp(-rate) - price + call, 6) + 0.0 AS put FROM c""")
def wl_blackscholes(spark, d):
    call, put = workloads.black_scholes(F.col("l_quantity"), F.lit(25.0), F.lit(1.0), F.col("l_tax"), F.col("l_discount") + 0.1)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(call, 6).alias("call"), F.round(put, 6).alias("put"))


@query("""WITH g AS (SELECT vec_id AS i, CAST(unnest(range(64)) AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    s AS (SELECT i, j, lag(v) OVER c + lead(v) OVER c + lag(v) OVER r + lead(v) OVER r - 4 * v AS v FROM g WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i))
    SELECT i, j, round(v, 5) AS v FROM s WHERE v IS NOT NULL""")
def wl_centdiff(spark, d):
    e = load(spark, d, "embeddings")
    n = e.agg(F.max("vec_id")).first()[0]
    long = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    return workloads.centered_difference(Grid(long, (n or 0) + 1, 64)).df.select("i", "j", F.round("v", 5).alias("v"))


def _jacobi(rounds: int) -> str:
    """SQL of Jacobi steps; the neighbours of a cell are the rows before and after it in its row and column."""
    out = "WITH g0 AS (SELECT vec_id AS i, CAST(unnest(range(64)) AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
    for n in range(rounds):
        out += f""", g{n + 1} AS (SELECT i, j, CASE WHEN i > 0 AND i < (SELECT max(vec_id) FROM embeddings) AND j BETWEEN 1 AND 62
            THEN (lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c) / 4 ELSE v END AS v FROM g{n} WINDOW r AS (PARTITION BY i ORDER BY j), c AS (PARTITION BY j ORDER BY i))"""
    return f"{out} SELECT i, j, round(v, 6) AS v FROM g{rounds}"


@query(_jacobi(3))
def wl_laplace(spark, d):
    e = load(spark, d, "embeddings")
    long = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    n = e.agg(F.max("vec_id")).first()[0]
    return workloads.laplace(Grid(long, (n or 0) + 1, 64), 3).df.select("i", "j", F.round("v", 6).alias("v"))


@query("""WITH a AS (SELECT c_custkey, (CAST(1111000000000 AS HUGEINT) + c_custkey) * 1000000 + 131400 AS n FROM customer)
    SELECT c_custkey, (n + CASE WHEN c_custkey % 3 = 0 THEN 98 - n % 97 ELSE 0 END) % 97 = 1 AS ok FROM a""")
def wl_iban(spark, d):
    # Every third customer has right check digits, the others 00; written in groups of four in four ways.
    account = F.lit(1_111_000_000_000).cast("bigint") + F.col("c_custkey")
    check = F.when(F.col("c_custkey") % 3 == 0, 98 - (account * 1_000_000 + 131_400) % 97).otherwise(0)
    plain = F.concat(F.lit("de"), F.lpad(check.cast("string"), 2, "0"), F.lpad(account.cast("string"), 13, "0"))
    between = F.element_at(F.array(*map(F.lit, ("", " ", "-", "."))), (F.col("c_custkey") % 4 + 1).cast("int"))
    written = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substring(plain, i * 4 + 1, F.lit(4))), "~")
    return load(spark, d, "customer").select("c_custkey", workloads.iban_valid(F.replace(written, F.lit("~"), between)).alias("ok"))


@query("""WITH RECURSIVE s AS (SELECT vec_id, CAST(list_grade_up(CAST(embedding[1:8] AS DOUBLE[])) AS INTEGER[]) AS p, 0 AS n FROM embeddings
        UNION ALL SELECT vec_id, list_concat(list_reverse(p[1:p[1]]), p[p[1] + 1:]), n + 1 FROM s WHERE p[1] <> 1)
    SELECT vec_id, CAST(max(n) AS BIGINT) AS flips FROM s GROUP BY 1""")
def wl_fannkuch(spark, d):
    # The order of the first eight components is a permutation of 1..8.
    places = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 8), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
    return load(spark, d, "embeddings").select("vec_id", workloads.prefix_flips(F.transform(F.array_sort(places), lambda p: p["i"]), 22).cast("bigint").alias("flips"))


@query("""WITH RECURSIVE f AS (SELECT user_id, event_type AS c, min(struct_pack(ts := ts, event_id := event_id)) AS at FROM events GROUP BY 1, 2),
    n AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM f x JOIN f y ON x.user_id = y.user_id AND x.at < y.at GROUP BY 1, 2),
    e AS (SELECT n.a, n.b, n.n AS w FROM n LEFT JOIN n m ON m.a = n.b AND m.b = n.a WHERE n.n > coalesce(m.n, 0)),
    p AS (SELECT a, b, w, 1 AS k FROM e UNION ALL SELECT p.a, e.b, least(p.w, e.w), k + 1 FROM p JOIN e ON p.b = e.a WHERE p.a <> e.b AND k < 6),
    best AS (SELECT a, b, max(w) AS w FROM p GROUP BY 1, 2)
    SELECT c AS candidate, CAST(coalesce(wins, 0) AS BIGINT) AS wins FROM (SELECT DISTINCT c FROM f)
    LEFT JOIN (SELECT x.a, count(*) AS wins FROM best x LEFT JOIN best y ON y.a = x.b AND y.b = x.a WHERE x.w > coalesce(y.w, 0) GROUP BY 1) ON a = c""")
def wl_schulze(spark, d):
    """Customers rank market segments of their orders' priorities: each user ranks event types by first use."""
    first = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    ballots = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]).alias("ranked"))
    return workloads.schulze_ranking(ballots, "user_id", "ranked")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
