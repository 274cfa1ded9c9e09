"""Flow records to the typed flow table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.functions import network
from lumenloom.functions.maps import lookup, once
from lumenloom.operators.enrich import small

_KINDS = {"string": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(), "time": T.LongType(), "small": T.ShortType()}
#: The table's 60 columns in order, and their kinds; times are seconds since 1970.
COLUMNS = [
    ("cloud", "string"),
    ("account_id", "string"),
    ("region", "string"),
    ("source_file", "string"),
    ("insert_id", "string"),
    ("loaded_at", "time"),
    ("loader", "string"),
    ("exporter", "string"),
    ("collector", "string"),
    ("vpc_id", "string"),
    ("peer_vpc_id", "string"),
    ("subnet_id", "string"),
    ("interface_id", "string"),
    ("input_interface", "string"),
    ("output_interface", "string"),
    ("vlan_id", "integer"),
    ("instance_id", "string"),
    ("src_instance", "string"),
    ("dst_instance", "string"),
    ("srcaddr", "string"),
    ("dstaddr", "string"),
    ("pkt_srcaddr", "string"),
    ("pkt_dstaddr", "string"),
    ("srcport", "integer"),
    ("dstport", "integer"),
    ("protocol", "integer"),
    ("packets", "long"),
    ("bytes", "long"),
    ("sampling_rate", "integer"),
    ("tcp_flags", "integer"),
    ("type", "string"),
    ("flow_direction", "string"),
    ("traffic_path", "string"),
    ("dscp", "integer"),
    ("next_hop", "string"),
    ("src_asn", "long"),
    ("dst_asn", "long"),
    ("start_time", "time"),
    ("end_time", "time"),
    ("action", "string"),
    ("log_status", "string"),
    ("version", "integer"),
    ("src_k8s_cluster", "string"),
    ("src_k8s_namespace", "string"),
    ("src_k8s_pod", "string"),
    ("src_k8s_workload", "string"),
    ("dst_k8s_cluster", "string"),
    ("dst_k8s_namespace", "string"),
    ("dst_k8s_pod", "string"),
    ("dst_k8s_workload", "string"),
    ("src_service", "string"),
    ("dst_service", "string"),
    ("flow_type", "string"),
    ("sequence_num", "long"),
    ("received_at", "time"),
    ("ip_version", "small"),
    ("src_mac", "string"),
    ("dst_mac", "string"),
    ("icmp_type", "small"),
    ("icmp_code", "small"),
]
FLOW_SCHEMA = T.StructType([T.StructField(n, _KINDS[k]) for n, k in COLUMNS])

#: Numbers of protocols by name.
PROTOCOLS = {
    "hopopt": 0, "icmp": 1, "igmp": 2, "ggp": 3, "ipv4": 4, "st": 5, "tcp": 6, "cbt": 7, "egp": 8, "igp": 9, "pup": 12, "udp": 17, "xns-idp": 22, "rdp": 27, "iso-tp4": 29,
    "dccp": 33, "xtp": 36, "ddp": 37, "ipv6": 41, "ipv6-route": 43, "ipv6-frag": 44, "idrp": 45, "rsvp": 46, "gre": 47, "dsr": 48, "esp": 50, "ah": 51, "narp": 54,
    "ipv6-icmp": 58, "ipv6-nonxt": 59, "ipv6-opts": 60, "eigrp": 88, "ospfigp": 89, "ax.25": 93, "ipip": 94, "etherip": 97, "encap": 98, "pim": 103, "ipcomp": 108, "vrrp": 112,
    "l2tp": 115, "stp": 118, "ptp": 123, "isis over ipv4": 124, "sctp": 132, "fc": 133, "mobility header": 135, "udplite": 136, "mpls-in-ip": 137, "manet": 138, "hip": 139,
    "shim6": 140, "wesp": 141, "rohc": 142, "ethernet": 143, "nsh": 145,
}
SECOND_NS, FIRST_NS, LAST_NS = 1_000_000_000, 946_684_800_000_000_000, 4_102_444_800_000_000_000
INT32 = (-(1 << 31), (1 << 31) - 1)


def clamp(v: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(v, F.lit(high)))


def protocol_number(name: Column) -> Column:
    """A number as it is, a name by the table, 0 for others."""
    return F.coalesce(name.try_cast("int"), lookup(name, PROTOCOLS), F.lit(0))


def action(forwarding_status: Column) -> Column:
    """By the upper two bits: 1 forwarded, 2 dropped."""
    code = F.shiftright(forwarding_status, 6)
    return F.when(code == 1, "ACCEPT").when(code == 2, "REJECT").otherwise("")


_TEXTS = ("flow.type", "flow.direction", "flow.next_hop", "flow.src_mac", "flow.dst_mac")
_NUMBERS = (
    "source.port", "destination.port", "source.as.number", "destination.as.number", "flow.src_as", "flow.dst_as", "flow.io.packets", "flow.io.bytes", "flow.in_if", "flow.out_if", "flow.tcp_flags", "flow.ip_tos",
    "flow.forwarding_status", "flow.time_received", "flow.start", "flow.end", "flow.sampling_rate", "flow.vlan_id", "flow.sequence_num", "flow.icmp_type", "flow.icmp_code",
)


def flow_rows(
    flows: DataFrame, routers: DataFrame | None = None, loader: str = "", collector: str = "", attributes: str = "attributes", received_ns: str | None = None, fields: dict[str, Column] | None = None
) -> DataFrame:
    """The flow table's rows; records without two readable addresses are left out.

    The fields of a flow come from the map ``attributes``, or from the columns of
    ``fields`` (attribute name -> column), which need no map. Times are seconds
    since 1970. Start and end outside of 2000 to 2099 both take the time
    received. routers: address, account_id, region, sampling_rate, direction;
    the exporter's address finds its row, IPv4 in IPv6 form as IPv4. The record's
    sampling rate goes before the router's, 1 is the last resort.
    """
    if fields is None:
        flows = once(flows, {attributes: F.col(attributes)})
        fields = {k: F.col(attributes)[k] for k in (*_TEXTS, *_NUMBERS, "source.address", "destination.address", "flow.sampler_address", "network.transport")}
    found = lambda k: fields[k] if k in fields else F.lit(None)
    src, dst, sampler = (found(k).cast("string") for k in ("source.address", "destination.address", "flow.sampler_address"))
    flows = flows.where(network.is_address(src) & network.is_address(dst))
    # Every field is read, and every address brought to its short form, once.
    read = {"_src": network.canonical(src), "_dst": network.canonical(dst), "_exporter": F.coalesce(network.canonical(sampler), sampler), "_protocol": protocol_number(found("network.transport").cast("string"))}
    read |= {f"_{k}": found(k).cast("string") for k in _TEXTS} | {f"_{k}": found(k).try_cast("long") for k in _NUMBERS}
    received = F.col(received_ns).cast("long") if received_ns else F.lit(None).cast("long")
    flows = once(flows.withColumn("_given", received), read).select("_given", *[f"`{k}`" for k in read])
    if routers is not None:
        r = routers.select(network.canonical(F.col("address")).alias("_exporter"), F.struct("account_id", "region", "sampling_rate", "direction").alias("_route")).where("_exporter IS NOT NULL").dropDuplicates(["_exporter"])
        flows = flows.join(small(r), "_exporter", "left")
    else:
        flows = flows.withColumn("_route", F.lit(None).cast("struct<account_id:string,region:string,sampling_rate:int,direction:string>"))
    s = lambda k: F.col(f"`_{k}`")
    zero = lambda *k: F.coalesce(*map(s, k), F.lit(0).cast("long"))
    i32 = lambda v: clamp(v, *INT32).cast("int")
    valid = lambda ns: F.coalesce(ns.between(FIRST_NS, LAST_NS - 1), F.lit(False))
    seconds = lambda ns: F.call_function("div", ns, F.lit(SECOND_NS))
    text = lambda v: F.coalesce(v, F.lit(""))
    received = F.when(valid(s("flow.time_received")), s("flow.time_received")).otherwise(F.col("_given"))
    good = valid(s("flow.start")) & valid(s("flow.end"))
    rate = F.when(zero("flow.sampling_rate") > 0, s("flow.sampling_rate")).when(F.coalesce(F.col("_route.sampling_rate"), F.lit(0)) > 0, F.col("_route.sampling_rate").cast("long")).otherwise(1)
    made = {
        "cloud": F.lit("onprem"),
        "account_id": text(F.col("_route.account_id")),
        "region": text(F.col("_route.region")),
        "loader": F.lit(loader),
        "exporter": text(F.col("_exporter")),
        "collector": F.lit(collector),
        "input_interface": zero("flow.in_if").cast("string"),
        "output_interface": zero("flow.out_if").cast("string"),
        "vlan_id": i32(zero("flow.vlan_id")),
        "srcaddr": F.col("_src"),
        "dstaddr": F.col("_dst"),
        "srcport": i32(zero("source.port")),
        "dstport": i32(zero("destination.port")),
        "protocol": F.col("_protocol"),
        "packets": zero("flow.io.packets"),
        "bytes": zero("flow.io.bytes"),
        "sampling_rate": i32(rate),
        "tcp_flags": i32(zero("flow.tcp_flags")),
        "flow_direction": text(F.coalesce(F.nullif(s("flow.direction"), F.lit("")), F.col("_route.direction"))),
        "dscp": i32(F.shiftright(zero("flow.ip_tos"), 2)),
        "next_hop": text(s("flow.next_hop")),
        "src_asn": zero("source.as.number", "flow.src_as"),
        "dst_asn": zero("destination.as.number", "flow.dst_as"),
        "start_time": seconds(F.when(good, s("flow.start")).otherwise(received)),
        "end_time": seconds(F.when(good, s("flow.end")).otherwise(received)),
        "action": action(s("flow.forwarding_status")),
        "flow_type": text(s("flow.type")),
        "sequence_num": clamp(zero("flow.sequence_num"), 0, (1 << 32) - 1),
        "received_at": seconds(received),
        "ip_version": F.when(F.col("_src").contains(":"), 6).otherwise(4),
        "src_mac": text(s("flow.src_mac")),
        "dst_mac": text(s("flow.dst_mac")),
        "icmp_type": clamp(zero("flow.icmp_type"), 0, 255),
        "icmp_code": clamp(zero("flow.icmp_code"), 0, 255),
    }
    blank = {"string": F.lit(""), "integer": F.lit(0), "long": F.lit(0), "time": F.lit(None), "small": F.lit(0)}
    return flows.select(*[made.get(name, blank[kind]).cast(_KINDS[kind]).alias(name) for name, kind in COLUMNS])


def used_columns(rows: DataFrame) -> list[str]:
    """The columns that some row fills, found by one aggregate."""
    tests = []
    for name, kind in COLUMNS:
        c = F.col(name)
        filled = c.isNotNull() & (c != "" if kind == "string" else (c != 0))
        tests.append(F.max(F.coalesce(filled, F.lit(False))).alias(name))
    got = rows.agg(*tests).first().asDict()
    return [n for n, _ in COLUMNS if got[n]]


def write_batches(write: Callable[[DataFrame], None], most_seconds: float = 300, first_wait: float = 5, longest_wait: float = 30) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: ``write`` again after growing waits until ``most_seconds`` are over; errors of the schema at once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        began, wait = time.monotonic(), first_wait
        while True:
            try:
                write(batch)
                return
            except Exception as e:
                kind = type(e).__name__
                if kind == "AnalysisException" or time.monotonic() - began + wait > most_seconds:
                    raise
                time.sleep(wait)
                wait = min(2 * wait, longest_wait)

    return run


def sampled_volume(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes and packets per key, each flow times its sampling rate."""
    return rows.groupBy(*keys).agg(F.sum(F.col("bytes") * F.col("sampling_rate")).alias("bytes"), F.sum(F.col("packets") * F.col("sampling_rate")).alias("packets"))


