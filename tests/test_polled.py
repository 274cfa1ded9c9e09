"""Polled sources: windows, restarts of a stream, repeated pages, and texts within nested bodies."""

import json

import pytest
from pyspark.sql import functions as F

from lumenloom.operators import enrich, processes, windowhist
from lumenloom.sources import polled

MIN = 60_000_000


def respond(folder, name, *pages):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps({"events": [{"timestamp": t // 1000, "eventId": i, "message": m, "logStreamName": "s"} for t, i, m in p]}) + "\n" for p in pages))


def test_windows_are_made_up_for_and_end_where_the_last_began():
    assert polled.windows(None, 600, 100, 1000) == [(500, 600)]
    assert polled.windows(250, 600, 100, 1000) == [(250, 300), (300, 400), (400, 500), (500, 600)]
    assert polled.windows(0, 600, 100, 200) == [(400, 500), (500, 600)]
    assert polled.windows(0, 600, 100, 0) == [(500, 600)] and polled.windows(600, 600, 100, 1000) == []


def test_a_batch_reads_each_event_of_its_windows_once(spark, tmp_path):
    respond(tmp_path / "a1" / "eu" / "g%2Fx", "1", [(0, "e0", "early"), (5 * MIN, "e1", "x")], [(5 * MIN, "e1", "x"), (10 * MIN - 1000, "e2", "y"), (10 * MIN, "e3", "late")])
    respond(tmp_path / "account=a2" / "region=us" / "group=g", "1", [(6 * MIN, "e1", "z"), (7 * MIN, None, "no id"), (7 * MIN, "e4", None)], [])
    polled.register(spark)
    df = spark.read.format("polled").options(path=tmp_path.as_uri(), since_us=5 * MIN, until_us=12 * MIN, delay_s=120, period_s=300).load()
    assert sorted((r.account, r.region, r.log_group, r.event_id, r.message) for r in df.collect()) == [("a1", "eu", "g/x", "e1", "x"), ("a1", "eu", "g/x", "e2", "y"), ("a2", "us", "g", "e1", "z")]
    assert spark.read.format("polled").options(path=(tmp_path / "none").as_uri(), until_us=MIN).load().count() == 0


def test_a_stream_goes_on_after_a_restart_with_each_record_once(spark, tmp_path):
    polled.register(spark)
    base, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")

    def run(until):
        live = spark.readStream.format("polled").options(path=base.as_uri(), since_us=0, until_us=until, period_s=60).load()
        q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted((r.log_group, r.event_id) for r in spark.read.parquet(out).collect())

    respond(base / "a" / "r" / "g1", "1", [(10_000_000, "e1", "m"), (3 * MIN - 1_000_000, "e2", "m"), (3 * MIN, "e3", "m")])
    assert run(3 * MIN + 30_000_000) == [("g1", "e1"), ("g1", "e2")]
    assert run(3 * MIN + 40_000_000) == [("g1", "e1"), ("g1", "e2")]
    respond(base / "a" / "r" / "g1", "2", [(3 * MIN, "e3", "m"), (4 * MIN, "e4", "m"), (9 * MIN, "e5", "m")])
    respond(base / "a" / "r" / "g2", "1", [(4 * MIN, "e1", "m")])
    assert run(6 * MIN) == [("g1", "e1"), ("g1", "e2"), ("g1", "e3"), ("g1", "e4"), ("g2", "e1")]
    assert run(20 * MIN)[-2:] == [("g1", "e5"), ("g2", "e1")]


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, body string").orderBy("i").select(column).collect()]


def test_texts_of_nested_bodies_in_order(spark):
    long = json.dumps([f'{i} "quoted" \\ ' for i in range(20_000)])
    docs = ['{"a":"1","b":{"c":["2",{"d":"3"},4,null,true]},"e":"x:\\"y\\" : z"}', "[]", "{}", '["a" , "b"]', "plain", "{not json", None, "", '"quoted"', '{"":""}', '["\\u00e9\\n"]']
    assert values(spark, enrich.leaves(F.col("body")), *docs) == [["1", "2", "3", 'x:"y" : z'], [], [], ["a", "b"], ["plain"], ["{not json"], [], [""], ['"quoted"'], [""], ["é\n"]]
    assert len(values(spark, enrich.leaves(F.col("body")), long)[0]) == 20_000
    deep = "[" * 60 + '"10.0.0.1"' + "]" * 60
    assert values(spark, enrich.leaves(F.col("body")), deep) == [["10.0.0.1"]]


def test_a_record_without_an_address_stays_as_it_is(spark):
    df = spark.createDataFrame([(1, "no", {"k": "v"}), (2, "10.0.0.1 10.0.0.2 10.0.0.1", None), (3, None, {"p": '["10.0.0.3"]'})], "i int, body string, attributes map<string,string>")
    got = {r.i: r.attributes for r in enrich.address_attribute(df, "ip", attributes=["p"]).collect()}
    assert got == {1: {"k": "v"}, 2: {"ip": "10.0.0.1,10.0.0.2"}, 3: {"p": '["10.0.0.3"]', "ip": "10.0.0.3"}}
    assert {r.i: r.attributes.get("ip") for r in enrich.address_attribute(df, "ip", first_only=True).collect()} == {1: None, 2: "10.0.0.1", 3: None}
    assert enrich.address_attribute(df, "ip", body=False).collect() == df.collect()


def test_medians_over_many_different_values_and_ties(spark):
    n = 30_001
    df = spark.range(n).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % n / 7 - 2000).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", v) for v in (5.0, 1.0, 1.0, 4.0)] + [("c", None), ("d", -3.0), ("d", None), ("e", 0.0), ("e", -1e-9), ("e", 1e300), ("e", -7.0)], "k string, v double"))
    got = {r.k: r.p50 for r in windowhist.medians(df, ["k"], "v").collect()}
    assert got == {"a": (n // 2) / 7 - 2000, "b": 2.5, "d": -3.0, "e": -5e-10}


@pytest.mark.parametrize("chunk_us", [1_000, 60_000_000])
def test_scrapes_whose_times_lie_within_one_day_are_many_tasks(spark, chunk_us):
    """A scrape goes over several chunks; only a row of each is carried."""
    df = spark.range(4000).select(((F.col("id") % 40) * 2_000_000 + F.col("id") * 50).alias("at_us"))
    got = {r.at_us: r.scrape_us for r in processes.scrape_ends(df, chunk_us=chunk_us).collect()}
    ends = {}
    for at in got:
        ends[at // 2_000_000] = max(ends.get(at // 2_000_000, 0), at)
    assert len(got) == 4000 and all(got[at] == ends[at // 2_000_000] for at in got)
