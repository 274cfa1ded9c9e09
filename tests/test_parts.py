"""Parts that queries reach only in one form: cuts, forms, readers, writers, hot runs of lines."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lumenloom.functions import agents, cuts, maps, pairs
from lumenloom.functions.patterns import captures, re2
from lumenloom.operators import hardware, windowhist
from lumenloom.operators import recombine as rc
from lumenloom.operators.logshape import devices as device_lines
from lumenloom.operators.logshape import lines
from lumenloom.sinks import flowlog
from lumenloom.sources import aws, devices
from lumenloom.sources.tables import spread


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


def test_cutting_at_marks(spark):
    ok, pieces = cuts.cut(F.col("t"), "[", "] ", ": ")
    read = F.when(ok, F.array(*pieces))
    assert values(spark, read, "a[b] c: d: e", "é[ü] ñ: \U0001f600", "[] : ", "a] b[c: d", "a[b] c", None) == [["a", "b", "c", "d: e"], ["é", "ü", "ñ", "\U0001f600"], ["", "", "", ""], None, None, None]
    assert values(spark, cuts.until_last(F.col("t"), "::"), "a::b::c", "abc", "::") == ["a::b", None, ""]
    assert values(spark, cuts.behind(F.col("t"), "::"), "a::b::c", "abc", "::") == ["b::c", None, ""]
    assert values(spark, cuts.last(F.col("t"), "::"), "a::b::c", "abc") == ["c", "abc"]


def test_what_pieces_look_like(spark):
    t = F.col("t")
    assert values(spark, cuts.digits(t), "12", "", "1a", "-1") == [True, False, False, False]
    assert values(spark, cuts.fraction(t, f"{cuts.DATE} {cuts.CLOCK},"), "2026-06-18 08:12:15,123", "2026-06-18 08:12:15,", "2026-06-18 08:12:15.123", "2026-6-18 08:12:15,123") == [True, False, False, False]
    assert values(spark, cuts.solid(t), "a", "", "a b") == [True, False, False]
    assert values(spark, F.array(cuts.first_line(t), cuts.more_lines(t)), "a\nb\nc", "a") == [["a", "\nb\nc"], ["a", None]]
    ok, (method, target, _) = cuts.request(t)
    assert values(spark, F.when(ok, F.concat(method, target)), "GET / HTTP/1.1", "GET /", "GET / x y") == ["GET/", None, None]


@pytest.mark.parametrize("form,fits,others", [
    (lines.klog_line, ["I0102 15:04:05.123456       7 a.go:12] msg", "E1231 00:00:00.1 1 b.go:1]"], ["X0102 15:04:05.1 7 a.go:12] m", "I0102 15:04:05 7 a.go:12] m", "I0102 15:04:05.1 7 a.go] m", "I0102 15:04:05.1 a.go:12] m"]),
    (lines.combined_line, ['1.2.3.4 - - [02/Jan/2026:15:04:05 +0000] "GET / HTTP/1.1" 200 5 "-" "x"', '1.2.3.4 - u [t] "GET / HTTP/1.1" 200 5 "-" "x" "9.9.9.9"'], ['1.2.3.4 - - [t] "GET /" 200 5 "-" "x"', '1.2.3.4 - - [t] "GET / HTTP/1.1" OK 5 "-" "x"']),
    (lines.postgres_line, ["2026-01-02 03:04:05.123 UTC [12] LOG:  ready", "2026-01-02 03:04:05.123 CET [12] ERROR:  no\nmore"], ["2026-01-02 03:04:05 UTC [12] LOG:  ready", "2026-01-02 03:04:05.123 UTC [x] LOG:  ready", "2026-01-02 03:04:05.123 UTC [12] SAID:  ready"]),
    (lines.redis_line, ["1:M 19 Nov 2026 23:22:38.000 * ok"], ["1:Q 19 Nov 2026 23:22:38.000 * ok", "1:M 19 Nop 2026 23:22:38.000 * ok", "1:M 19 Nov 2026 23:22:38.000 ? ok"]),
    (device_lines.old_line, ["Jan  2 03:04:05 host app: x", "Dec 31 10:05:00 h"], ["Jam  2 03:04:05 host", "Jan 2 03:04 host", "Jan 2 03:04:05"]),
    (device_lines.ios_line, ["12: *Jan  2 03:04:05.123: %SYS-5-CONFIG_I: done", "12: Jan 2 03:04:05: %A-0-B:"], ["12: *Jan  2 03:04:05.123: SYS-5-CONFIG_I: done", "x: *Jan 2 03:04:05: %SYS-5-CONFIG_I: done"]),
    (device_lines.tagged, ["sshd[4]: x", "cron: y", "a/b-c[1]:z"], ["no tag", "two words: x", "a[b]: x", "[4]: x"]),
])
def test_what_forms_take_and_refuse(spark, form, fits, others):
    ok = F.coalesce(form(F.col("t")).ok, F.lit(False))
    assert values(spark, ok, *fits, *others) == [True] * len(fits) + [False] * len(others)


def test_codes_of_devices(spark):
    got = values(spark, device_lines.coded(F.col("t")), "x: %LINK-3-UPDOWN: Interface Gi1/0/1", "50% off: %SYS-5-CONFIG_I: y", "%link-3-UPDOWN: z", "%A-9-B: z", "none")
    assert got == [["", "LINK", "3", "UPDOWN"], ["", "SYS", "5", "CONFIG_I"], None, None, None]


def test_a_line_that_holds_the_mark_of_groups(spark):
    got = values(spark, captures(F.col("t"), "^(a)-(b)$"), "a-b", "x\x01y\x01z", "a\x01-b")
    assert got == [["", "a", "b"], ["xyz"], ["", "a", "b"]]
    lines = spark.createDataFrame([("junk\x01some\x011\x012\x013\x014",)], "value string")
    assert devices.pressure(lines, []).count() == 0


def test_pairs_in_order_and_the_last_of_a_key(spark):
    kv = pairs.found(F.col("t"), pairs.ESCAPED)
    row = 'a=1 b="x \\"y\\"" a=2 c="" d=e=f a='
    assert values(spark, kv.k, row)[0] == ["a", "b", "a", "c", "d", "a"]
    assert values(spark, F.concat_ws("|", pairs.last_value(kv, "b"), pairs.last_value(kv, "d")), row) == ['x "y"|e=f']
    assert values(spark, pairs.last_value(kv, "a"), row) == [None] and values(spark, pairs.value(kv, "c", "a"), row) == ["1"]
    assert values(spark, pairs.line(kv, ["d"]), row) == ['a=1 b="x \\"y\\"" a=2']
    assert values(spark, pairs.as_map(kv, "p.", ["b"]), row) == [{"p.a": "2", "p.d": "e=f"}]
    assert values(spark, kv.v, "q='it' r=\"a b\" s='")[0] == ["it", "a b", "'"]


def test_once_keeps_names_and_values(spark):
    df = maps.once(spark.range(3), {"x.y": F.col("id") + 1, "z": F.col("id").cast("string")})
    assert [tuple(r) for r in df.collect()] == [(0, 1, "0"), (1, 2, "1"), (2, 3, "2")] and df.columns == ["id", "x.y", "z"]


def test_small_sources_are_dealt_over_all_cores(spark):
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=64)).rdd.getNumPartitions() == 64


def test_flow_files_as_text_and_parquet(spark, tmp_path):
    (tmp_path / "a.txt").write_text("version srcaddr dstaddr srcport protocol bytes action\n2 10.0.0.1 10.0.0.2 443 6 - ACCEPT\n")
    text = aws.read_vpc_text(spark, str(tmp_path / "a.txt"))
    spark.createDataFrame([("2", "10.0.0.1", "10.0.0.2", "443", "6", None, "ACCEPT")], "version string, srcaddr string, dstaddr string, srcport string, protocol string, bytes string, action string").write.parquet(str(tmp_path / "p"))
    parquet = aws.read_vpc_parquet(spark, str(tmp_path / "p"))
    for df in (text, parquet):
        r = df.first().asDict()
        assert (r["source.address"], r["source.port"], r["network.transport"], r["aws.vpc.flow.bytes"]) == ("10.0.0.1", 443, "tcp", None)


def test_batches_are_written_again_until_they_are(spark, monkeypatch):
    waits, tries = [], []
    monkeypatch.setattr(flowlog, "time", SimpleNamespace(sleep=waits.append, monotonic=lambda: 0.0))

    def write(df):
        tries.append(df.count())
        if len(tries) < 4:
            raise OSError("not now")

    flowlog.write_batches(write, first_wait=5, longest_wait=8)(spark.range(2), 0)
    assert tries == [2] * 4 and waits == [5, 8, 8]
    with pytest.raises(OSError):
        flowlog.write_batches(lambda df: (_ for _ in ()).throw(OSError()), most_seconds=0)(spark.range(1), 1)


def test_flow_rows_from_a_map_and_from_columns_are_the_same(spark):
    flows = spark.createDataFrame([("10.0.0.1", "2001:DB8::1", 443, "7", 6, 3, 100), ("::ffff:10.0.0.3", "10.0.0.2", None, "x", 99, 9, None), ("bad", "10.0.0.2", 1, "1", 1, 1, 1)], "src_addr string, dst_addr string, src_port long, bytes string, protocol int, flow_type int, sampling_rate int")
    a = flowlog.flow_rows(devices.flow_attributes(flows)).collect()
    b = flowlog.flow_rows(flows, fields=devices.flow_fields(flows)).collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr) and len(a) == 2
    assert {(r.srcaddr, r.dstaddr, r.bytes, r.protocol, r.sampling_rate) for r in a} == {("10.0.0.1", "2001:db8::1", 7, 6, 100), ("10.0.0.3", "10.0.0.2", 0, 0, 1)}


def test_a_source_of_continuation_lines_alone_is_cut(spark):
    lines = spark.createDataFrame([("s", i, f"  at {i}") for i in range(95)], "k string, n long, line string")
    got = rc.fold_traces(lines, "k", "n", "line", most_lines=20).collect()
    assert sorted(r.n_lines for r in got) == [15, 20, 20, 20, 20] and sum(len(r.body.split("\n")) for r in got) == 95


def test_medians_exact_and_by_summary(spark):
    df = spark.createDataFrame([("s", 0, float(v)) for v in (1, 2, 3, 10)], "s string, t long, v double")
    p50 = lambda how: [r.value for r in windowhist.aligned_stats(df, ["s"], "v", "t", 60, how).where("stat = 'p50'").collect()]
    assert p50("summary") == [2.0] and p50("exact") == [2.5] and p50(None) == []


def test_rules_read_their_input_once(spark):
    df = spark.createDataFrame([("m", "1", 2.0, {"k": "v"})], "metric string, unit string, value double, attributes map<string,string>")
    rules = [hardware.Rule("m", "t", scale=2.0), hardware.Rule("n", "u"), hardware.Rule("o", "w", states=("ok", "failed"), state_map={"1": "ok"})]
    out = hardware.map_points(df, rules)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [(r.metric, r.value) for r in out.collect()] == [("t", 4.0)]


@pytest.mark.parametrize("agent,os,version", [("Mozilla/5.0 (Windows NT 10.0; Win64)", "Windows", "10.0"), ("x (Macintosh; Intel Mac OS X 10_15_7)", "macOS", "10.15.7"), ("x (X11; Linux x86_64)", "Linux", None), ("x (iPhone; CPU iPhone OS 17_0)", "iOS", "17.0"), ("curl/8", None, None), ("x (iPad; CPU OS 16_1)", "iPadOS", "16.1")])
def test_systems_of_agents(spark, agent, os, version):
    assert values(spark, agents.system(F.col("t")), agent) == [os] and values(spark, agents.system_version(F.col("t")), agent) == [version]


@pytest.mark.parametrize("who,short", [
    ("system:serviceaccount:ns:sa", "sa"), ("system:node:n1.x", "node-n1.x"), ("system:kube-proxy", "kube-proxy"), ("arn:aws:sts::1:assumed-role/R/session", "session"), ("ec2.amazonaws.com", "AWS Internal"), ("ann@x.org", "ann"),
    ("plain", "plain"), ("", None), ("service-1@container-engine-robot.iam", "gke-robot"), ("@x", "@x"),
])
def test_short_principals(spark, who, short):
    assert values(spark, agents.short_principal(F.col("t")), who) == [short]


def test_masks_of_backends(spark):
    assert values(spark, agents.backend_service(F.col("t")), "k8s1-0a1b2c3d-a-b-4e5f6a7b", "k8s-0a1b2c3d-x", "plain-name", "k8s2-zzzzzzzz-a-4e5f6a7b") == ["a-b", "k8s-0a1b2c3d-x", "plain-name", "k8s2-zzzzzzzz-a-4e5f6a7b"]


def test_six_bit_fields_of_a_unit(spark):
    assert re2("a$") == r"(?d)a\z"
    kinds = spark.createDataFrame([(2, bytearray(b"\x29\xdc\xa6")), (3, bytearray(b"ab \x00")), (1, bytearray(b"\x12\xa3")), (0, bytearray(b"\x0a\xff")), (3, bytearray(b""))], "k long, r binary")
    assert [r[0] for r in kinds.select(hardware._fru_text(F.col("k"), F.col("r"))).collect()] == ["IPMI", "ab", "12 3", "0aff", ""]
