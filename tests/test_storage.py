"""Links between storage documents: held and linked parts, missing and absent ones, paths outside of the root."""

import json

from lumenloom.sources import storage

LINK = lambda p: {"@odata.id": p}
DOCUMENTS = [
    ("h", "/r/s", {"Members": [LINK("/r/s/1"), LINK("/r/s/2"), LINK("/r/s/gone"), LINK("/r/s/1"), {}]}),
    ("h", "/r/s/1", {"Id": "1", "Name": "first", "Status": {"Health": "Warning"}, "StorageControllers": [{"Model": "c"}], "Controllers": LINK("/r/s/1/C"), "Volumes": LINK("/r/s/1/V"),
     "Drives": [LINK("/r/s/1/D/a?x=1"), LINK("/r/s/1/D/bad"), LINK("/r/s/1/../x"), LINK("/other/d"), {"Id": "own", "CapacityBytes": 5}, {}, LINK("/r/s/1/D/gone"), LINK("/r/s/1/D/empty")]}),
    ("h", "/r/s/1/C", {"Members": [LINK("/r/s/1/C/never")]}),
    ("h", "/r/s/1/D/a", {"Status": {"Health": "Critical", "State": "Enabled"}, "CapacityBytes": 7, "PredictedMediaLifeLeftPercent": 75, "FailurePredicted": True, "Revision": "r1"}),
    ("h", "/r/s/1/D/empty", {"Id": "e", "Status": {"State": "Absent"}}),
    ("h", "/other/d", {"Id": "outside"}),
    ("h", "/r/s/1/V", {"Members": [LINK("/r/s/1/V/v1")]}),
    ("h", "/r/s/1/V/v1", {"RAIDType": "RAID5", "CapacityBytes": 9, "Status": {"Health": "OK"}}),
    ("h", "/r/s/2", {"Status": {"State": "Absent", "Health": "OK"}, "StorageControllers": [], "Controllers": LINK("/r/s/2/C"), "Volumes": LINK("/r/s/2/V")}),
    ("h", "/r/s/2/C", {"Members": [LINK("/r/s/2/C/x"), LINK("/r/s/2/C/y"), {"MemberId": "m", "Name": "held"}]}),
    ("h", "/r/s/2/C/x", {"SpeedGbps": 12, "Status": {"Health": "Odd"}}),
    ("i", "/r/s/1/D/gone", {"Id": "of another host"}),
]


def table(spark, documents):
    rows = [(h, p, d if isinstance(d, str) else json.dumps(d), 1) for h, p, d in documents]
    return spark.createDataFrame(rows, "host string, path string, value string, storage int")


def test_parts_and_health(spark):
    every = [*DOCUMENTS, ("h", "/r/s/1/D/bad", "{no json"), ("h", None, "{}"), (None, "/r/s", "{}"), ("h", "/r/s/2/C/y", "[]")]
    parts = storage.storage_parts(table(spark, every), "/r/s").cache()
    got = {(r.storage, r.kind, r.id): r for r in parts.collect() if r.id}
    found = {k for k, r in got.items() if r.found}
    assert found == {("1", "storage", "1"), ("1", "controller", "1"), ("1", "drive", "a"), ("1", "drive", "own"), ("1", "volume", "v1"), ("2", "controller", "0"), ("2", "controller", "m")}
    assert set(got) - found == {("gone", "storage", "gone"), ("1", "drive", "bad"), ("1", "drive", "x"), ("1", "drive", "d"), ("1", "drive", "gone"), ("2", "controller", "y")}
    a = got["1", "drive", "a"]
    assert (a.state, a.capacity, a.endurance, a.predicted, a.firmware, a.name) == ("failed", 7, 0.25, True, "r1", "a")
    assert (got["1", "storage", "1"].drives, got["1", "storage", "1"].state, got["1", "volume", "v1"].raid, got["2", "controller", "0"].speed_gbps, got["2", "controller", "0"].state) == (8, "degraded", "RAID5", 12, None)
    health = {r.storage: (r.worst, r.n_parts, r.n_missing, r.drive_bytes) for r in storage.storage_health(parts).collect()}
    # Without ids: the empty entry of the drives, the second storage's volumes, the empty member of the root.
    assert health == {"1": ("failed", 4, 5, 12), "2": (None, 2, 2, None), "gone": (None, 0, 1, None), None: (None, 0, 1, None)}


def test_no_documents(spark):
    assert storage.storage_parts(table(spark, DOCUMENTS).limit(0), "/r/s").count() == 0
