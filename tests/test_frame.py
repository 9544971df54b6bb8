import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skiff.operators.frame import Frame, Literal
from skiff.operators.position import shared_path
from skiff.plans.values import NotRecordable, choose
from skiff.sources import io


@pytest.fixture
def abc(spark):
    df = io.from_columns(spark, {"a": [0, 2, 2, 1], "b": [4.5, 0.5, 2.5, 7.0], "c": ["a", "c", "b", "d"]})
    return Frame(df, ("_pos",), [("_pos", True)])


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sort_directions(abc):
    out = abc.sort_values(["a", "b"], [True, False]).to_pandas()
    assert out["c"].tolist() == ["a", "d", "b", "c"]


def test_nan_sorts_last_both_ways(spark):
    f = Frame(spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double"))
    for up, want in ((True, [1.0, 2.0]), (False, [2.0, 1.0])):
        got = [r.v for r in f.sort_values("v", up).ordered().collect()]
        assert got[:2] == want and math.isnan(got[2])


def test_slices(abc):
    assert rows(abc[1:-1].df.select("c").orderBy("c")) == [("b",), ("c",)]
    assert rows(abc[:2].df.select("c").orderBy("c")) == [("a",), ("c",)]
    assert rows(abc[-1:].df.select("c")) == [("d",)]
    assert rows(abc.iloc[2].df.select("c")) == [("b",)]
    with pytest.raises(ValueError):
        abc[0:3:2]


def test_top_k_plan_has_no_full_sort(abc):
    assert "TakeOrderedAndProject" in plan(abc.sort_values("b")[:2].df)


def test_no_sort_below_aggregate(abc):
    assert "Sort [" not in plan(abc.sort_values("b").groupby("a").agg(s=("b", "sum")).df)


def test_recorded_function_needs_no_python(abc):
    s = abc.assign(x=abc["a"].apply(lambda v: choose(v > 1, v * 10, -v), strict=True))
    assert "Python" not in plan(s.df)
    assert sorted(r.x for r in s.df.collect()) == [-1, 0, 20, 20]


def test_fallback_runs_as_arrow_udf(abc):
    def width(s) -> int:
        return len(s) + 1

    out = abc.assign(x=abc["c"].apply(width)).df
    assert "ArrowEvalPython" in plan(out) and {r.x for r in out.collect()} == {2}
    with pytest.raises(NotRecordable):
        abc["c"].apply(width, strict=True)
    with pytest.raises(TypeError):
        abc["c"].apply(lambda s: len(s))


def test_series_keep_their_version(abc):
    old = abc["a"]
    abc["a"] = abc["a"] + 100
    abc["before"] = old
    # a series taken before reads the frame as it was
    assert sorted(r[0] for r in old.to_df("v").select("v").collect()) == [0, 1, 2, 2]


def test_row_function(abc):
    out = abc.assign(t=abc.apply(lambda r: r["c"] + "_" + r.c, axis=1)).df
    assert {r.t for r in out.collect()} == {"a_a", "b_b", "c_c", "d_d"}


def test_joins(spark):
    a = Frame(spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k int, x double"))
    b = Frame(spark.createDataFrame([(1, 5, "p"), (3, 6, "q")], "k int, n int, s string"))
    assert rows(a.merge(b, on="k").df) == [(1, 1.0, 5, "p")]
    left = {r.k: r for r in a.merge(b, how="left", on="k").df.collect()}
    assert left[1].n == 5.0 and math.isnan(left[2].n) and left[2].s is None
    n = Frame(spark.createDataFrame([(float("nan"), 1)], "y double, m int"))
    assert a.merge(n, left_on="x", right_on="y").df.count() == 0
    with pytest.raises(ValueError):
        a.merge(Frame(b.df.withColumnRenamed("n", "x")), on="k")
    with pytest.raises(ValueError):
        a.merge(b, how="outer", on="k")


def test_groups(abc):
    got = {r.a: (r.s, r.m) for r in abc.groupby("a").agg(s=("b", "sum"), m=("b", "min")).df.collect()}
    assert got[2] == (3.0, 0.5)
    assert {r.a: r.c for r in abc.groupby(["a"])["c"].nunique().df.collect()}[2] == 2
    with pytest.raises(ValueError):
        abc.groupby("a").agg(s=("b", "max"))


def test_sums(abc, spark):
    assert abc["c"].sum().first()[0] == "acbd"
    assert abc["a"].sum().first()[0] == 5
    empty = Frame(spark.createDataFrame([], "v long, w double"))
    assert empty["v"].sum().first()[0] == 0 and empty["w"].sum().first()[0] == 0.0


def test_positional_alignment(spark):
    a = Frame(io.from_columns(spark, {"x": [1, 2, 3]}), ("_pos",), [("_pos", True)])
    b = Frame(io.from_columns(spark, {"y": [10, 100, 1000]}), ("_pos",), [("_pos", True)])
    s = a["x"] + b["y"]
    assert sorted(r[0] for r in s.frame.df.select(s.col).collect()) == [11, 102, 1003]


def test_reset_index_and_isin(abc):
    out = abc.sort_values("b", False).reset_index("index").df.orderBy("index").select("index", "c").collect()
    assert [tuple(r) for r in out] == [(0, "d"), (1, "a"), (2, "b"), (3, "c")]
    assert abc["c"].isin(["a", "z"]).to_df("v").where("v").count() == 1


def test_mask_fillna_strings(abc):
    s = abc["b"].mask(abc["a"] > 1, float("nan")).fillna(9.0)
    assert sorted(r[0] for r in s.to_df("v").select("v").collect()) == [4.5, 7.0, 9.0, 9.0]
    t = abc["c"].str
    assert {r[0] for r in t.upper().to_df("v").select("v").collect()} == set("ABCD")
    assert abc["c"].str.slice(0, 1).to_df("v").count() == 4
    assert abc.df.select(F.lit(1)).count() == 4


def test_aggregate_folds_partitions_before_the_shuffle(spark):
    data = [(i % 3 if i % 2 else None, float(i)) for i in range(1000)] + [(9, None), (1, None)]
    f = Frame(spark.createDataFrame(data, "k long, v double").repartition(8))
    out = f.groupby("k")["v"].aggregate((0.0, 0), lambda s, v: (s[0] + v, s[1] + 1), lambda s: s[0] / s[1], lambda a, b: (a[0] + b[0], a[1] + b[1]), "double")
    want = {k: [v for x, v in data if x == k and v is not None] for k, _ in data}
    assert {r.k: r.v for r in out.collect()} == {k: sum(v) / len(v) if v else None for k, v in want.items()}
    text = plan(out)
    assert "collect_list" not in text and [s for s in text.split() if s.startswith("MapInArrow") or s.startswith("Exchange")][:3] == ["MapInArrow", "Exchange", "MapInArrow"]


def test_folds_keep_the_order_and_hold_no_group(abc, spark):
    down = abc.sort_values("b", False)
    assert rows(down["c"].fold("", lambda s, v: s + v)) == [("dabc",)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = down["c"].fold("", lambda s, v: s + v, ["a"])
        assert sorted(rows(out)) == [(0, "a"), (1, "d"), (2, "bc")] and "collect_list" not in plan(out)
        assert sorted(rows(down.groupby("a")["b"].aggregate(1.0, lambda s, v: s * 10 + v))) == [(0, 14.5), (1, 17.0), (2, 125.5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(abc[abc["a"] > 5]["a"].fold(7, lambda s, v: s + v)) == [(7,)]
    with pytest.raises(TypeError):
        abc.groupby("a")["b"].aggregate((0.0, 0), lambda s, v: s)


def test_a_row_is_a_series(spark):
    f = Frame(spark.createDataFrame([(2, "x", 0.5), (1, "y", 1.5)], "k long, s string, v double"), order=[("k", True)])
    row = f.iloc[1]
    assert (row.values, row.index, row.name, row["s"]) == ([2, "x", 0.5], ["k", "s", "v"], 1, "x")
    assert f.iloc[-1].values == row.values and f.iloc[-2]["k"] == 1
    for bad in (2, -3):
        with pytest.raises(IndexError):
            f.iloc[bad]


def test_literal_series(spark):
    s = Literal([5.0, 7.0, 6.0], ["a", "b", "c"], "v")
    f = s.to_frame(spark)
    assert s["b"] == 7.0 and len(s) == 3 and f.at_label("c").df.select("v").collect()[0].v == 6.0
    assert f["v"].to_arrow().to_pylist() == [5.0, 7.0, 6.0] and Literal([1]).index == [0]
    with pytest.raises(ValueError):
        Literal([1, 2], ["a"])
    with pytest.raises(KeyError):
        s["z"]


def test_texts_are_summed_in_order(spark):
    rows = [(i, None if i % 7 == 0 else chr(97 + i % 26)) for i in range(200)]
    f = Frame(spark.createDataFrame(rows[::-1], "k long, s string").repartition(5), order=[("k", True)])
    assert f["s"].sum().first()[0] == "".join(x for _, x in rows if x)
    assert f[f["k"] < 0]["s"].sum().first()[0] == ""


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        known = {"spark.master": master, "spark.checkpoint.dir": folder}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: known.get(k) or d))

    assert shared_path(session("local[4]"), "x").startswith("file://") and shared_path(session("yarn", "hdfs://a/b/"), "x").startswith("hdfs://a/b/x-")
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            shared_path(session(master), "x")
