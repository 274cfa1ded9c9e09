"""The joins that follow links between storage documents share one reading of the documents."""

import json

from lumenloom.sources import storage

LINK = lambda p: {"@odata.id": p}
DOCUMENTS = [
    ("h", "/s", {"Members": [LINK("/s/1"), LINK("/s/2"), LINK("/s/1")]}),
    ("h", "/s/1", {"Id": "1", "Status": {"Health": "OK"}, "StorageControllers": [{"CapacityBytes": "no number", "Id": "c", "Status": {"Health": "Warning"}}], "Controllers": LINK("/s/1/C"), "Drives": [LINK("/s/1/D"), {"Id": "held", "CapacityBytes": 2}]}),
    ("h", "/s/1/D", {"CapacityBytes": 3, "Status": {"Health": "Critical"}, "Name": 5, "Model": {"a": 1}}),
    ("h", "/s/1/C", {"Members": [LINK("/s/1/C/x")]}),
    ("h", "/s/2", {"Status": 5, "Controllers": LINK("/s/2/C"), "Volumes": LINK("/s/2/V"), "Drives": [LINK("/s/2/D")]}),
    ("h", "/s/2/C", {"Members": [LINK("/s/1/C/x")]}),
    ("h", "/s/1/C/x", {"SpeedGbps": 12}),
    ("h", "/s/2/V", {"Members": []}),
    ("h", "/s/2/D", "{cut"),
]


def test_documents_are_read_once(spark, tmp_path):
    rows = [(h, p, d if isinstance(d, str) else json.dumps(d)) for h, p, d in DOCUMENTS]
    spark.createDataFrame(rows, "host string, path string, value string").write.parquet(str(tmp_path / "documents"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        health = storage.storage_health(storage.storage_parts(spark.read.parquet(str(tmp_path / "documents")), "/s"))
        got = {r.storage: (r.worst, r.n_parts, r.n_missing, r.drive_bytes) for r in health.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {"1": ("failed", 3, 0, 5), "2": (None, 1, 1, None)}
    plan = health._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # A scan for the collections of storages and one for what is linked; a join for each step of links.
    assert (plan.count("FileScan"), plan.count("SortMergeJoin")) == (2, 3)
