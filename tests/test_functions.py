import math
from urllib.parse import urlparse, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skiff.functions import collections as lists
from skiff.functions import dates, numeric, text, urls
from skiff.operators import scoring, workloads
from skiff.operators.arrays import Grid


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_integers(spark):
    for a, b in ((-7, 2), (7, -2), (7, 2), (-6, 3)):
        x = F.lit(a).cast("bigint")
        assert one(spark, numeric.int_div(x, b), numeric.remainder(x, b), numeric.floor_div(x, b), numeric.python_mod(x, b)) == (int(a / b), math.fmod(a, b), a // b, a % b)


def test_floats(spark):
    inf = one(spark, numeric.float_div(F.lit(7.0), F.lit(0.0)), numeric.float_div(F.lit(-7.0), F.lit(0.0)), numeric.float_div(F.lit(0.0), F.lit(0.0)))
    assert inf[:2] == (math.inf, -math.inf) and math.isnan(inf[2])
    nan = F.lit(float("nan"))
    assert one(spark, numeric.eq(nan, nan), numeric.gt(nan, F.lit(1.0)), numeric.lt(F.lit(0.0), F.lit(1.0))) == (False, False, True)
    assert one(spark, *[numeric.float_text(F.lit(v)) for v in (1.0, 1 / 3, 6.6, 0.0)]) == ("1.0", "0.333333", "6.6", "0.0")
    assert one(spark, numeric.log(F.lit(0.0)), numeric.erf(F.lit(1.0)))[1] == pytest.approx(0.8427007929497149)
    assert one(spark, numeric.to_int(F.lit("12abc")), numeric.to_int_prefix(F.lit(" 12abc")), numeric.bankers_round(F.lit(2.5))) == (None, 12, 2.0)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abcé ,", max_size=12), st.text("abé,", min_size=1, max_size=2), st.integers(-4, 6), st.integers(-4, 6))
def test_strings_match_python(spark, s, sub, a, b):
    c = F.lit(s)
    got = one(spark, text.find(c, sub), text.rfind(c, sub), text.slice_(c, a, b), text.replace(c, sub, "xy"), text.contains(c, sub), text.partition(c, sub), text.rpartition(c, sub), text.split(c, sub), text.strip(c))
    want = (s.find(sub), s.rfind(sub), s[a:b], s.replace(sub, "xy"), sub in s, s.partition(sub), s.rpartition(sub), s.split(sub), s.strip(text.BLANKS))
    assert tuple(tuple(x) if isinstance(x, (tuple, list)) else x for x in got) == tuple(tuple(x) if isinstance(x, (tuple, list)) else x for x in want)


def test_urls(spark):
    for u in ("http://user:pw@Host:80/a/b;p=1?q=2#f", "mailto:a@b", "//h/p?x", "path;x/y;z", "HTTP://h", ""):
        got = one(spark, urls.urlparse(F.lit(u)), urls.urlsplit(F.lit(u)))
        assert tuple(got[0]) == tuple(urlparse(u)) and tuple(got[1]) == tuple(urlsplit(u))
    assert tuple(one(spark, urls.netloc_parts(F.lit("u:p@h:8")))[0]) == ("u", "p", "h", 8)
    assert tuple(one(spark, urls.netloc_parts(F.lit("h")))[0]) == (None, None, "h", None)


def test_dates(spark):
    got = one(spark, dates.parse(F.lit("2020-02-03")), dates.parse(F.lit("2020-02-03T04:05:06")), dates.parse(F.lit("x")), dates.year(dates.from_nanos(F.lit(1431857103000000000))))
    assert (got[0].day, got[1].hour, got[2], got[3]) == (3, 4, None, 2015)


def test_lists(spark):
    a = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    got = one(spark, lists.item(a, -1), lists.cut(a, 1, -1, 2), lists.put(a, 0, F.lit(9)), lists.reshape(a, 2, 2), lists.get_or(F.create_map(F.lit("a"), F.lit(1)), F.lit("b"), F.lit(7)))
    assert got == (5, [2, 4], [9, 2, 3, 4, 5], [[1, 2], [3, 4]], 7)


def test_models(spark):
    assert one(spark, scoring.LinearRegression([1, 2], 3).predict([F.lit(3.0), F.lit(5.0)])) == (16.0,)
    x = [F.lit(1.0), F.lit(1.0)]
    assert one(spark, scoring.LogisticRegression([[1, 0], [1, 0], [2, 0]], [0, 0, -1]).predict(x), scoring.KMeans([[0, 1], [2, 1]]).predict(x)) == (0, 0)


def test_workloads(spark):
    assert one(spark, workloads.iban_valid(F.lit("DE91100000000123456789")), workloads.iban_valid(F.lit("DE91100000000123456788"))) == (True, False)
    assert one(spark, text.levenshtein(F.lit("kitten"), F.lit("sitting"))) == (3,)
    assert workloads.fannkuch(spark, 4).first()[0] == 4
    call, put = one(spark, *workloads.black_scholes(*[F.lit(4.0)] * 5))
    assert call == pytest.approx(3.99986565, abs=1e-3) or call > 0
    assert one(spark, workloads.haversine(F.lit(0.0698132), F.lit(0.0698132)))[0] == pytest.approx(4839.95317247, abs=1e-3)
    assert sum(workloads.peaks([1.0] * 150)) in (0, 1)


def test_ticks_stream(spark):
    values = {k: [(i * i * (j + 3)) % 17 + 900 * (i % 41 == 0) for i in range(200)] for j, k in enumerate(["a", "b", None])}
    ticks = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, i long, v long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = workloads.tick_peaks(ticks, "k", F.timestamp_seconds("i"), F.col("v"), lag=5, threshold=2.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {r.symbol: r.peaks for r in out.collect()} == {k: sum(workloads.peaks(v, 5, 2.0)) for k, v in values.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_listing_fixture(spark):
    df = spark.createDataFrame(
        [(f"{b} bds , {b - 1} ba , {q} sqft", t, p, z, "New York", "NY", "u", "1 Fifth Ave") for b, q, t, p, z in ((2, "1,000", "House For Sale", "$100,000", "10001"), (3, "1,500", "House For Rent", "$2,000/mo", "10002"), (4, "2,000", "House For Sale", "$200,000", "10003"))],
        "`facts and features` string, title string, price string, postal_code string, city string, state string, url string, address string",
    )
    r = workloads.clean_listings(df).collect()
    assert len(r) == 1
    assert (r[0].zipcode, r[0].city, r[0].bedrooms, r[0].bathrooms, r[0].sqft, r[0].offer, r[0].type, r[0].price) == ("10003", "New york", 4, 3, 2000, "sale", "house", 200000)


def test_log_fixture(spark):
    line = '1.2.3.4 - frank [10/Oct/2000:13:55:36 -0700] "GET /~ann/x.gif HTTP/1.0" 200 203023'
    r = workloads.parse_logs(spark.createDataFrame([(line,), ("short",)], "line string")).collect()
    assert [(x.ip, x.user_id, x.date, x.method, x.endpoint, x.protocol, x.response_code, x.content_size) for x in r] == [("1.2.3.4", "frank", "10/Oct/2000:13:55:36 -0700", "GET", "/~/x.gif", "HTTP/1.0", 200, 203023)]


def test_grid(spark):
    g = Grid.filled(spark, 3, 4, 1.0).put(slice(0, 1), slice(0, 4), 5.0)
    assert g.view(slice(0, 3, 2), slice(1, -1)).shape == (2, 2)
    r = {(x.i, x.j): x.v for x in g.reshape(4, 3).df.collect()}
    assert r[1, 0] == 5.0 and r[1, 1] == 1.0
    s = {(x.i, x.j): x.v for x in workloads.laplace(g, 1).df.collect()}
    assert s[1, 1] == 2.0 and s[0, 0] == 5.0 and len(s) == 12


def test_schulze(spark):
    df = spark.createDataFrame([(i, list("abc")) for i in range(3)] + [(9, list("cba"))], "v int, r array<string>")
    assert {x.candidate: x.wins for x in workloads.schulze_ranking(df, "v", "r").collect()} == {"a": 2, "b": 1, "c": 0}


def test_stream_matches_batch(spark, tmp_path):
    from skiff.streaming.ticks import volume_by_second

    df = spark.createDataFrame([("A", "2020-01-01 00:00:00.1", 1.0), ("A", "2020-01-01 00:00:00.9", 2.0), ("B", "2020-01-01 00:00:05", 3.0)], "s string, t string, v double")
    df.select("s", F.col("t").cast("timestamp").alias("t"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t timestamp, v double").parquet(str(tmp_path / "in"))
    q = volume_by_second(stream, "s", "t", "v").writeStream.format("memory").queryName("ticks_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = volume_by_second(spark.read.parquet(str(tmp_path / "in")), "s", "t", "v")
    assert sorted(map(tuple, spark.table("ticks_out").collect())) == sorted(map(tuple, batch.collect()))


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    from skiff.sources import io

    t = pa.table({"x": [1, 2, 3], "s": ["a", None, "c"]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), t.schema) as w:
        w.write_table(t)
    assert [tuple(r) for r in io.scan_arrow(spark, f"file://{tmp_path}/t.arrow").orderBy("x").collect()] == [(1, "a"), (2, None), (3, "c")]


def test_erf(spark):
    xs = [-7.0, -5.5, -2.0, -0.47, -0.3, 0.0, 0.1, 0.46, 1.0, 3.99, 4.01, 5.9, 30.0]
    got = one(spark, *[numeric.erf(F.lit(x)) for x in xs])
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-14) and math.isnan(one(spark, numeric.erf(F.lit(float("nan"))))[0])


def test_list_order_text_and_shape(spark):
    def a(*v):
        return F.array(*map(F.lit, v))

    got = one(spark, lists.less(a(1, 2), a(1, 3)), lists.less(a(1, 4), a(2, 3)), lists.less(a(1, 2), a(1, 2, 3)), lists.less(a(0), a(1, -5)))
    assert got == (True, False, False, True)
    shown = one(spark, lists.list_text(a("x", "it's"), lists.quoted), lists.list_text(a(1, 2), lambda c: c.cast("string")), lists.dict_text(F.create_map(F.lit("k"), F.lit(1)), lists.quoted, lambda c: c.cast("string")))
    assert shown == (repr(["x", "it's"]), repr([1, 2]), repr({"k": 1}))
    assert one(spark, lists.rectangular(F.array(a(1, 2), a(3, 4)))) == ([[1, 2], [3, 4]],)
    with pytest.raises(Exception, match="different lengths"):
        one(spark, lists.rectangular(F.array(a(1, 2), a(3))))


def test_stored_models(spark):
    class LinearRegression:
        coef_, intercept_ = [2.0, -1.0], 0.5

    class MinMaxScaler:
        data_min_, scale_ = [1.0, 0.0], [0.5, 2.0]

    class Pipeline:
        steps = [("scale", MinMaxScaler()), ("fit", LinearRegression())]

    x = [F.lit(3.0), F.lit(4.0)]
    read = scoring.from_json(scoring.to_json(scoring.from_fitted(Pipeline())))
    assert one(spark, scoring.from_fitted(LinearRegression()).predict(x), read.predict(x)) == (2.5, 0.5 + 2 * 1.0 - 8.0)


def test_iban_in_groups(spark):
    good = ("GB82 WEST 1234 5698 7654 32", "GB82-WEST-1234-5698-7654-32", "gb82.west.1234.5698.7654.32", "GB82WEST12345698765432")
    assert one(spark, *[workloads.iban_valid(F.lit(x)) for x in good], workloads.iban_valid(F.lit(good[0].replace("82", "83")))) == (True, True, True, True, False)


def test_prefix_flips(spark):
    def plain(p):
        p, n = list(p), 0
        while p[0] != 1:
            p[: p[0]] = p[: p[0]][::-1]
            n += 1
        return n

    for p in ([1, 2, 3, 4], [4, 3, 2, 1], [3, 1, 4, 2], [2, 4, 1, 3]):
        assert one(spark, workloads.prefix_flips(F.array(*map(F.lit, p)), 4)) == (plain(p),)


def test_letters_order_and_pairs(spark):
    a = F.array(*map(F.lit, (3, 1, 2)))
    got = one(spark, text.ascii_lower(F.lit("ÀBc")), text.ascii_upper(F.lit("éb")), lists.in_order(a), lists.in_order(a, True), lists.enumerated(a, 1))
    assert got[:4] == ("Àbc", "éB", [1, 2, 3], [3, 2, 1]) and [tuple(p) for p in got[4]] == [(1, 3), (2, 1), (3, 2)]
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, lists.keys(m), lists.fold(lists.items(m), F.lit(0), lambda s, e: s + e["value"])) == (["a", "b"], 3)


def test_cells_of_a_grid(spark):
    g = Grid.filled(spark, 4, 5, 1.0).put_grid(slice(0, 4, 2), slice(1, 3), Grid.filled(spark, 2, 2, 7.0))
    cells = {(r.i, r.j): r.v for r in g.df.collect()}
    assert len(cells) == 20 and {k for k, v in cells.items() if v == 7.0} == {(0, 1), (0, 2), (2, 1), (2, 2)}
    assert g.at(2, -3).first().v == 7.0 and g.at(1, 1).first().v == 1.0
    less = g.zip(Grid.filled(spark, 4, 5, 5.0), lambda x, y: x < y)
    assert less.df.where("v").count() == 16
    one_, two = (sorted(tuple(r) for r in Grid.random(spark, 3, 3, 7).df.collect()) for _ in range(2))
    assert one_ == two and all(0 <= v < 1 for _, _, v in one_)
    for bad in (lambda: g.put_grid(slice(0, 2), slice(0, 2), g), lambda: g.zip(Grid.filled(spark, 1, 1, 0.0), lambda x, y: x)):
        with pytest.raises(ValueError):
            bad()
