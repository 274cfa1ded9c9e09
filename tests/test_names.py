"""Official names: their values, and that an attribute map is not read again for each of them."""

from pyspark.sql import functions as F

from lumenloom.operators import enrich

ROWS = [
    {},
    {"real_address": "10.0.0.1:5", "client.ip": "9.9.9.9", "code.filepath": "a/b.go:7", "rpc.service": "s", "rpc.method": "m"},
    {"real_address": "[2001:db8::1]:", "client.port": "1", "code.filepath": "b.go", "code.lineno": "3", "rpc.service": "", "rpc.method": "m"},
    {"client.ip": "9.9.9.9", "client.address": "1.1.1.1", "otelcol.component.id": "second", "winlog.computer_name": "gone", "x": "y"},
    {"otelcol.component": "first", "otelcol.component.id": "second", "common_name": "c", "interface": "e0", "machine.type": "t", "host.display_name": "h", "host.name": "own"},
]
WANT = [
    {},
    {"client.address": "10.0.0.1", "client.port": "5", "code.file.path": "a/b.go", "code.line.number": "7", "rpc.method": "s/m"},
    {"client.address": "2001:db8::1", "client.port": "1", "code.file.path": "b.go", "code.line.number": "3", "rpc.method": "m"},
    {"client.address": "1.1.1.1", "otel.component.name": "second", "x": "y"},
    {"otel.component.name": "first", "user.name": "c", "network.interface.name": "e0", "host.type": "t", "host.name": "own"},
]


def test_values(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([*ROWS, None])], "i int, a map<string,string>")
    got = {r.i: r.a for r in df.select("i", enrich.official_names(F.col("a")).alias("a")).collect()}
    assert got == dict(enumerate([*WANT, None]))


def test_the_map_is_built_once(spark):
    df = spark.createDataFrame([], "a map<string,string>").select(enrich.official_names(F.col("a")).alias("a"))
    assert df._jdf.queryExecution().analyzed().expressions().mkString(" ").count("map_filter(") <= 6
