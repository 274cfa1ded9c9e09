"""Status texts and tables of hosts and devices: VPN clients, pressure, pools, counters, disks, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import maps, network, times
from lumenloom.functions.patterns import captures, glob, group, re2
from lumenloom.operators.enrich import small

# -- OpenVPN status files


def openvpn_rows(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """path, snapshot, line (its place), kind (client or route), name, real_address, virtual_address, bytes_received, bytes_sent, since and since_us of each table row.

    files: whole texts. Forms 1 (titled sections), 2 (commas) and 3 (tabs). A
    file that does not end in END is not complete and gives nothing; rows with
    too few fields or unreadable counters are left out.
    """
    lines = F.transform(F.split(F.regexp_replace(F.trim(F.col(text)), "\r", ""), "\n"), lambda x: F.rtrim(x))
    whole = files.select(F.col(path).alias("path"), lines.alias("l")).where(F.element_at("l", -1) == "END")
    sep = F.when(F.exists("l", lambda x: x.startswith("TITLE\t")), "\t").otherwise(",")
    new = F.exists("l", lambda x: x.rlike("^(?:HEADER|TITLE)[,\t]"))
    snap = F.regexp_extract(F.get(F.filter("l", lambda x: x.rlike("^(?:TIME|Updated)[,\t]")), F.lit(0)), "^[^,\t]*[,\t]([^,\t]*)", 1)
    at = F.array_position("l", "ROUTING TABLE")
    rows = whole.select("path", F.nullif(snap, F.lit("")).alias("snapshot"), new.alias("new"), sep.alias("sep"), at.alias("routes_at"), F.posexplode("l").alias("i", "line"))
    f = F.split("line", F.when(F.col("sep") == "\t", "\t").otherwise(","))
    get = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit(""))
    kind = F.when(F.col("new"), F.when(get(0) == "CLIENT_LIST", "client").when(get(0) == "ROUTING_TABLE", "route")).otherwise(
        F.when((F.col("i") >= 3) & ((F.col("routes_at") == 0) | (F.col("i") < F.col("routes_at") - 1)) & (F.size(f) >= 5), "client").when((F.col("routes_at") > 0) & (F.col("i") > F.col("routes_at")) & (F.size(f) >= 4), "route")
    )
    rows = rows.withColumn("kind", kind)
    c, n = F.col("kind") == "client", F.col("new")
    out = rows.where("kind IS NOT NULL").select(
        "path", "snapshot", F.col("i").alias("line"), "kind",
        F.when(c, F.when(n, get(1)).otherwise(get(0))).otherwise(F.when(n, get(2)).otherwise(get(1))).alias("name"),
        F.when(c, F.when(n, get(2)).otherwise(get(1))).otherwise(F.when(n, get(3)).otherwise(get(2))).alias("real_address"),
        F.when(c, F.when(n, get(3))).otherwise(F.when(n, get(1)).otherwise(get(0))).alias("virtual_address"),
        F.when(c, F.when(n, F.when(F.size(f) >= 10, get(5)).otherwise(get(4))).otherwise(get(2))).try_cast("long").alias("bytes_received"),
        F.when(c, F.when(n, F.when(F.size(f) >= 10, get(6)).otherwise(get(5))).otherwise(get(3))).try_cast("long").alias("bytes_sent"),
        F.when(c, F.when(n, F.when(F.size(f) >= 10, get(7)).otherwise(get(6))).otherwise(get(4))).alias("since"),
    )
    out = out.withColumn("since_us", connected_us(F.col("since")))
    return out.where("kind = 'route' OR (name IS NOT NULL AND bytes_received IS NOT NULL AND bytes_sent IS NOT NULL)")


def connected_us(since: Column) -> Column:
    """``2026-06-18 08:12:15``, or ``Thu Jun 18 08:12:15 2026`` of the first form."""
    of_words = F.regexp_replace(F.regexp_replace(since, "^[A-Za-z]+ ", ""), " +", " ")
    return F.coalesce(times.utc_micros(since, "yyyy-MM-dd HH:mm:ss"), times.utc_micros(of_words, "MMM d HH:mm:ss yyyy"))


def openvpn_routes(clients: DataFrame, routes: DataFrame) -> DataFrame:
    """Clients with the virtual address of the first route of their file, by place in it, that has their name and address."""
    keys = ["path", "name", "real_address"]
    first = routes.groupBy(*keys).agg(F.min_by("virtual_address", "line").alias("_v"))
    return clients.join(first, keys, "left").withColumn("virtual_address", F.coalesce("virtual_address", "_v")).drop("_v")


def openvpn_totals(clients: DataFrame) -> DataFrame:
    """bytes and earliest start (text and microseconds) per name and address of a client's sessions."""
    ip = network.host(F.col("real_address"))
    start = [F.min_by("since", "since_us").alias("since"), F.min("since_us").alias("since_us")]
    return clients.groupBy("name", ip.alias("address")).agg(F.sum("bytes_received").alias("bytes_received"), F.sum("bytes_sent").alias("bytes_sent"), *start, F.count("*").alias("sessions"))


def new_snapshots(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of snapshots (path, snapshot) that ``seen`` lacks."""
    return rows.join(seen.select("path", "snapshot").distinct(), ["path", "snapshot"], "left_anti")


# -- pressure

PRESSURE = r"^(some|full) avg10=([\d.]+) avg60=([\d.]+) avg300=([\d.]+) total=(\d+)$"


def pressure(lines: DataFrame, keep: list[str], line: str = "value") -> DataFrame:
    """keep, kind, stat (avg10, avg60, avg300, total) and value of each pressure line; others are left out."""
    rows = lines.withColumn("_c", captures(F.trim(F.regexp_replace(F.col(line), " +", " ")), PRESSURE)).where(F.size("_c") > 1)
    g = lambda i: group(F.col("_c"), i).try_cast("double")
    wide = rows.select(*keep, group(F.col("_c"), 1).alias("kind"), g(2).alias("avg10"), g(3).alias("avg60"), g(4).alias("avg300"), g(5).alias("total"))
    return wide.unpivot([*keep, "kind"], ["avg10", "avg60", "avg300", "total"], "stat", "value")


def cgroups(df: DataFrame, path: str, include: list[str] | None = None, exclude: list[str] | None = None, depth: int | None = None, most: int | None = None) -> DataFrame:
    """Adds pod_uid, qos and container_id from a control group's path; keeps those the globs, the depth and the cap in path order allow."""
    p = F.col(path)
    if include:
        df = df.where(p.rlike("|".join(re2(glob(g, False)) for g in include)))
    if exclude:
        df = df.where(~p.rlike("|".join(re2(glob(g, False)) for g in exclude)))
    if depth is not None:
        df = df.where(F.size(F.filter(F.split(p, "/"), lambda x: x != "")) <= depth)
    if most is not None:
        df = df.orderBy(path).limit(most)
    uid = F.regexp_extract(p, r"pod([0-9a-f]{8}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{4}[-_][0-9a-f]{12})", 1)
    qos = F.when(p.rlike("kubepods[-/.a-z]*besteffort"), "besteffort").when(p.rlike("kubepods[-/.a-z]*burstable"), "burstable").when(p.contains("kubepods"), "guaranteed")
    return df.withColumns({"pod_uid": F.nullif(F.replace(uid, F.lit("_"), F.lit("-")), F.lit("")), "qos": qos, "container_id": F.nullif(F.regexp_extract(p, r"(?:^|[-/:])([0-9a-f]{64})(?:\.scope)?(?:/|$)", 1), F.lit(""))})


# -- pool tables


def _cells(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def newest_txg(files: DataFrame, keep: list[str], text: str = "value") -> DataFrame:
    """txg, dirty, written and sync_ns of the closed (state C) transaction group with the largest number in each table."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), _cells), lambda c: F.get(c, F.lit(0)) != "")
    head = F.get(F.filter(lines, lambda c: F.get(c, F.lit(0)) == "txg"), F.lit(0))
    rows = files.select(*keep, head.alias("h"), F.explode(lines).alias("c"))
    at = lambda name: F.get("c", F.array_position("h", name).cast("int") - 1)
    num = lambda name: at(name).try_cast("long")
    ok = rows.where((at("state") == "C") & num("txg").isNotNull() & num("ndirty").isNotNull() & num("nwritten").isNotNull() & num("stime").isNotNull())
    best = ok.groupBy(*keep).agg(F.max_by(F.struct(num("ndirty").alias("dirty"), num("nwritten").alias("written"), num("stime").alias("sync_ns")), num("txg")).alias("b"), F.max(num("txg")).alias("txg"))
    return best.select(*keep, "txg", "b.*")


def kstat_table(files: DataFrame, keep: list[str], text: str = "value") -> DataFrame:
    """name and value of ``name type data`` lines after the two head lines."""
    rows = files.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line")).where("i >= 2")
    c = _cells(F.col("line"))
    return rows.where((F.size(c) == 3) & F.get(c, F.lit(2)).try_cast("decimal(20,0)").isNotNull()).select(*keep, F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(2)).try_cast("decimal(20,0)").alias("value"))


def leaf_errors(vdevs: DataFrame, pool: list[str]) -> DataFrame:
    """Errors per pool summed over its leaf devices (is_leaf)."""
    return vdevs.where("is_leaf").groupBy(*pool).agg(F.sum("read_errors").alias("read_errors"), F.sum("write_errors").alias("write_errors"), F.sum("checksum_errors").alias("checksum_errors"))


# -- counters of network drivers


def picked_statistics(counters: DataFrame, keep: list[str], picks: list[tuple[str, str]], most: int, counter_map: str = "counters") -> DataFrame:
    """name, value and metric of a driver's counters by the first pattern that fits; the first ``most`` by name of each device."""
    rows = counters.select(*keep, F.explode(counter_map).alias("name", "value"))
    metric = F.lit(None).cast("string")
    for pattern, target in reversed(picks):
        metric = F.when(F.col("name").rlike(re2(pattern)), target).otherwise(metric)
    found = rows.withColumn("metric", metric).where("metric IS NOT NULL")
    w = Window.partitionBy(*keep).orderBy("name")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def sensor_points(readings: DataFrame) -> DataFrame:
    """Chip readings (kind: temp, fan, in; raw in thousandths but for fans) in degrees, turns and volts."""
    scaled = F.when(F.col("kind").isin("temp", "in"), F.col("raw") / 1000.0).otherwise(F.col("raw").cast("double"))
    metric = F.when(F.col("kind") == "temp", "hw.temperature").when(F.col("kind") == "fan", "hw.fan.speed").when(F.col("kind") == "in", "hw.voltage")
    return readings.withColumns({"metric": metric, "value": scaled}).where("metric IS NOT NULL")


def session_disks(sessions: DataFrame, disks: DataFrame, most: int) -> DataFrame:
    """Disks with their session's target and portal; the first ``most`` by session and number."""
    joined = disks.join(small(sessions), "session_id", "left")
    return joined.orderBy("session_id", "lun").limit(most)


# -- flows

TRANSPORTS = {1: "icmp", 2: "igmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp", 58: "ipv6-icmp", 89: "ospfigp", 132: "sctp"}
ETHERTYPES = {0x0800: "ipv4", 0x86DD: "ipv6"}
FLOW_TYPES = {0: "unknown", 1: "sflow_5", 2: "netflow_v5", 3: "netflow_v9", 4: "ipfix"}
U64 = (1 << 64) - 1


def named(c: Column, names: dict[int, str]) -> Column:
    out = F.lit("unknown")
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def folded(flows: DataFrame) -> DataFrame:
    """Version 9 flows count both directions: in and out bytes and packets are summed, up to 2^64 - 1; others keep their own."""
    top = F.lit(str(U64)).cast("decimal(20,0)")

    def total(name: str) -> Column:
        both = F.coalesce(F.col(f"in_{name}"), F.lit(0)).cast("decimal(21,0)") + F.coalesce(F.col(f"out_{name}"), F.lit(0)).cast("decimal(21,0)")
        own = F.coalesce(F.col(f"in_{name}"), F.lit(0)).cast("decimal(20,0)")
        return F.when(F.col("flow_type") == 3, F.least(both, top.cast("decimal(22,0)")).cast("decimal(20,0)")).otherwise(own)

    return flows.withColumns({"bytes": total("bytes"), "packets": total("packets")})


#: A time in milliseconds counts from 2000-01-01 up to 2100-01-01.
LEAST_MS, MOST_MS = 946_684_800_000, 4_102_444_800_000


def absolute_times(flows: DataFrame) -> DataFrame:
    """start_ns and end_ns of version 9 flows from their own millisecond fields, where a flow has one of them.

    flows: flow_type, start_ns, end_ns, the fields start_ms and end_ms, and
    first_switched and last_switched, all null where a record lacks them. A time
    out of the calendar is 0. A flow without any field of time gets 0 for both
    and not its header's time; other versions keep what they have.
    """
    v9 = F.col("flow_type") == 3
    ms = lambda c: F.when((F.col(c) >= LEAST_MS) & (F.col(c) < MOST_MS), F.col(c) * 1_000_000).otherwise(F.lit(0).cast("long"))
    none = F.coalesce("start_ms", "end_ms", "first_switched", "last_switched").isNull()
    time = lambda c: F.when(v9 & F.col(f"{c}_ms").isNotNull(), ms(f"{c}_ms")).when(v9 & none, F.lit(0).cast("long")).otherwise(F.col(f"{c}_ns"))
    return flows.withColumns({"start_ns": time("start"), "end_ns": time("end")})


#: Attributes of a flow and the decoded columns that they come from.
FLOW_COLUMNS = {
    "source.address": "src_addr",
    "source.port": "src_port",
    "destination.address": "dst_addr",
    "destination.port": "dst_port",
    "flow.io.bytes": "bytes",
    "flow.io.packets": "packets",
    "flow.sequence_num": "sequence",
    "flow.time_received": "received_ns",
    "flow.start": "start_ns",
    "flow.end": "end_ns",
    "flow.sampling_rate": "sampling_rate",
    "flow.sampler_address": "sampler",
    "flow.tcp_flags": "tcp_flags",
    "flow.in_if": "in_if",
    "flow.out_if": "out_if",
    "flow.ip_tos": "tos",
    "flow.icmp_type": "icmp_type",
    "flow.icmp_code": "icmp_code",
    "flow.src_mac": "src_mac",
    "flow.dst_mac": "dst_mac",
    "flow.vlan_id": "vlan_id",
    "flow.next_hop": "next_hop",
    "flow.src_as": "src_as",
    "flow.dst_as": "dst_as",
    "flow.forwarding_status": "forwarding_status",
}


def flow_fields(flows: DataFrame) -> dict[str, Column]:
    """The attributes of decoded flows as columns; those whose source is not there are left out."""
    found = {attr: F.col(c) for attr, c in FLOW_COLUMNS.items() if c in flows.columns}
    for attr, column, names in (("network.transport", "protocol", TRANSPORTS), ("network.type", "ethertype", ETHERTYPES), ("flow.type", "flow_type", FLOW_TYPES)):
        if column in flows.columns:
            found[attr] = named(F.col(column), names)
    return found


def flow_attributes(flows: DataFrame) -> DataFrame:
    """Adds attributes, the fields of decoded flows as a map of texts."""
    return flows.withColumn("attributes", maps.of(flow_fields(flows)))
