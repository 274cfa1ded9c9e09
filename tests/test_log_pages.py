"""Log pages by hand: refused, cut, and of every width."""

from pyspark.sql import functions as F

from lumenloom.operators import hardware

PAGES = {
    "last_reaches_over": "0300001A" + "000302011F" + "0006020800000000FFFFFFFE" + "00070209" + "00" * 5,
    "full": "02000011" + "0003020101" + "00060208FFFFFFFFFFFFFFFF",
    "nine_bytes": "0500000D" + "00030209" + "01" * 9,
    "none": "03000000",
    "cut_in_head": "03000020" + "0003020107" + "0006",
    "rest": "03000007" + "0003020107" + "0006",
    "over": "03000005" + "0003020307",
    "subpage": "43010000",
    "reserved": "0E010000",
    "short": "0E00",
    "empty": "",
    "hot": "0D00000C" + "0000020200FF" + "00000202002A",
    "exceptions": "2F000007" + "000002035D0B1E",
    "no_first": "2F000006" + "000102025D0B",
    "unknown": "15000000",
    "saved": "8E000008" + "0004020400000001",
}


def test_log_pages(spark):
    rows = spark.createDataFrame([*PAGES.items(), ("null", None)], "name string, raw string").select("name", F.unhex("raw").alias("page"), F.lit(7).alias("page_code"), F.lit("x").alias("parameters"))
    got = {r.name: r for r in hardware.log_pages(rows).collect()}
    assert {n for n, r in got.items() if r.page_code is None} == {"last_reaches_over", "rest", "over", "subpage", "reserved", "short", "empty", "null", "no_first"}
    assert (got["full"].operation, got["full"].corrected, got["full"].uncorrected) == ("write", 1, 2**64 - 1)
    assert (got["nine_bytes"].operation, got["nine_bytes"].corrected, got["nine_bytes"].uncorrected) == ("verify", 0, None)
    assert (got["none"].corrected, got["none"].uncorrected) == (0, None) and got["cut_in_head"].corrected == 7
    assert got["hot"].celsius == 42 and got["hot"].corrected is None
    assert (got["exceptions"].sense, got["exceptions"].qualifier, got["exceptions"].celsius, got["exceptions"].predicted_failure) == (93, 11, 30, True)
    assert got["saved"].cycles == 1
    assert got["unknown"].page_code == 21 and got["unknown"].predicted_failure is None


def test_log_parameters_keep_their_order(spark):
    rows = spark.createDataFrame([("0E000010" + "0004020100" + "00010200" + "0002020301" + "0203",)], "raw string").select(F.unhex("raw").alias("page"))
    found = hardware.log_parameters(rows).first().parameters
    assert [(x.code, bytes(x.data).hex()) for x in found] == [(4, "00"), (1, ""), (2, "010203")]
    assert hardware.log_pages(rows.limit(0)).count() == 0
