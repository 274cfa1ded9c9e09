"""Further operators: sensors, disks, chassis documents, control groups, agents, Windows events, text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.functions import agents, bodies, cleaning
from lumenloom.operators import filters, parsers, processes
from lumenloom.plans.common import EVENTS, events, table
from lumenloom.sources import cloud, devices


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "temp").when(F.col("event_type") == "click", "fan").when(F.col("event_type") == "error", "in").otherwise("odd")
    return devices.sensor_points(events(spark, sf_dir).select("event_id", kind.alias("kind"), F.col("cents").alias("raw"))).select("event_id", "metric", "value")


SENSORS = f"""
SELECT event_id, CASE event_type WHEN 'view' THEN 'hw.temperature' WHEN 'click' THEN 'hw.fan.speed' ELSE 'hw.voltage' END AS metric, CASE event_type WHEN 'click' THEN cents::DOUBLE ELSE cents / 1000.0::DOUBLE END AS value FROM {EVENTS} WHERE event_type IN ('view', 'click', 'error')
"""


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 customers as disks, with their nation as session."""
    sessions = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("session_id"), F.col("n_name").alias("target"))
    d = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("lun"))
    return devices.session_disks(sessions, d, 300).select("session_id", "lun", "target")


DISKS = "SELECT c_nationkey AS session_id, c_custkey AS lun, CASE WHEN n_nationkey < 20 THEN n_name END AS target FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey ORDER BY 1, 2 LIMIT 300"


def chassis(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = "concat('{\"Id\":\"', event_id, '\",\"Temperatures\":[{\"Name\":\"cpu\",\"ReadingCelsius\":', user_id, '}],\"Fans\":[{\"Name\":\"f1\",\"Reading\":', event_id, '},{\"Name\":\"f2\"}]', if(event_id % 2 = 0, ',\"PowerControl\":[{\"Name\":\"p\",\"PowerConsumedWatts\":12.5}]', ''), '}')"
    return cloud.redfish_points(events(spark, sf_dir).select(F.expr(doc).alias("value"))).withColumn("id", F.col("id").cast("long"))


CHASSIS = f"""
SELECT event_id AS id, 'hw.temperature' AS metric, 'cpu' AS name, user_id::DOUBLE AS value FROM {EVENTS} UNION ALL SELECT event_id, 'hw.fan.speed', 'f1', event_id::DOUBLE FROM {EVENTS}
UNION ALL SELECT event_id, 'hw.power', 'p', 12.5 FROM {EVENTS} WHERE event_id % 2 = 0
"""


def control_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = "concat('11111111-2222-3333-4444-', lpad(cast(event_id as string), 12, '0'))"
    path = f"concat('/kubepods.slice/kubepods-', if(event_id % 2 = 0, 'burstable', 'besteffort'), '.slice/kubepods-pod', replace({uid}, '-', '_'), '.slice/cri-containerd-', repeat(cast(event_id % 10 as string), 64), '.scope')"
    e = events(spark, sf_dir).select("event_id", F.expr(f"if(event_id % 5 = 0, concat('/system.slice/x', event_id), {path})").alias("path"))
    return devices.cgroups(e, "path", include=["/kube*/*/*/*", "/system.slice/*"], exclude=["/system.slice/x*5"], depth=4).select("event_id", "pod_uid", "qos", "container_id")


CONTROL_GROUPS = f"""
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN '11111111-2222-3333-4444-' || lpad(event_id::VARCHAR, 12, '0') END AS pod_uid, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'burstable' ELSE 'besteffort' END AS qos,
CASE WHEN event_id % 5 <> 0 THEN repeat((event_id % 10)::VARCHAR, 64) END AS container_id FROM {EVENTS} WHERE NOT (event_id % 5 = 0 AND event_id % 10 = 5)
"""

_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.1 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile Safari/604", "curl/8.1", "MyApp/2.5 extra", "Mozilla/5.0 (X11; Linux) Firefox/115.0", "-", "python-requests/2.31",
]
_AGENT_FACTS = [
    ("desktop", "Chrome", "120.1", "Windows"), ("mobile", "Safari", "604", "iOS"), ("bot", "curl", "8.1", None), ("desktop", "MyApp", "2.5", None), ("desktop", "Firefox", "115.0", "Linux"), (None, None, None, None), ("bot", "Python Requests", "2.31", None),
]


def user_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.nullif(F.element_at(F.array(*map(F.lit, _AGENTS)), (F.col("event_id") % len(_AGENTS) + 1).cast("int")), F.lit("-")).alias("a"))
    return e.select("event_id", F.when(F.col("a").isNotNull(), agents.device(F.col("a"))).alias("device"), agents.browser(F.col("a")).alias("name"), agents.browser_version(F.col("a")).alias("version"), agents.system(F.col("a")).alias("os"))


def _q(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


USER_AGENTS = f"SELECT event_id, device, name, version, os FROM {EVENTS} JOIN (VALUES {', '.join(f'({i}, {', '.join(map(_q, f))})' for i, f in enumerate(_AGENT_FACTS))}) a(i, device, name, version, os) ON event_id % {len(_AGENTS)} = i"


def windows_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.lit("Security").alias("channel"), F.when(F.col("event_id") % 2 == 0, "Microsoft-Windows-Kernel General").otherwise("Prov").alias("provider"), (4600 + F.col("event_id") % 5).alias("event_id"), (F.col("event_id") % 7).cast("int").alias("level"),
        F.when(F.col("event_id") % 11 == 0, F.array(F.lit("audit failure"))).alias("keywords"), F.concat(F.lit("pc"), "user_id").alias("computer"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("First "), "event_type", F.lit("\nsecond"))).alias("message"),
        F.create_map(F.lit("User"), F.concat(F.lit("u"), "user_id"), F.lit("A"), F.col("event_type")).alias("event_data"),
    )
    out = parsers.windows_events(e, {("Prov", 4601): "{User} did {A}{Nothing}!"})
    return out.select("id", "body", "severity_number", F.col("resource")["service.name"].alias("service"), F.col("attributes")["winlog.event_data.User"].alias("user"))


WINDOWS_LOG = f"""
SELECT event_id AS id, CASE WHEN event_id % 2 = 1 AND event_id % 5 = 1 THEN 'u' || user_id || ' did ' || event_type || '!' WHEN event_id % 3 = 0 THEN 'First ' || event_type
ELSE CASE WHEN event_id % 2 = 0 THEN 'Microsoft-Windows-Kernel General' ELSE 'Prov' END || ' event ' || (4600 + event_id % 5) || ' A=' || event_type || ' User=u' || user_id END AS body,
CASE WHEN event_id % 11 = 0 THEN 13 ELSE CASE event_id % 7 WHEN 0 THEN 9 WHEN 1 THEN 21 WHEN 2 THEN 17 WHEN 3 THEN 13 WHEN 4 THEN 9 WHEN 5 THEN 5 END END AS severity_number, CASE WHEN event_id % 2 = 0 THEN 'kernel-general' ELSE 'prov' END AS service, 'u' || user_id AS user FROM {EVENTS}
"""


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "event_id", cleaning.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "event_type", F.lit("\x1b[0m")), narrow=True).alias("plain"), cleaning.array_text(F.array("event_id", "user_id"), "-").alias("joined"), cleaning.array_text(F.array(F.lit(104), F.lit(105)), as_bytes=True).alias("bytes"),
        cleaning.unescape(F.concat("event_type", F.lit("\\x2d\\t."))).alias("raw"), bodies.duration_text(F.col("cents") * 1000).alias("took"), agents.short_principal(F.concat(F.lit("system:node:n"), "user_id")).alias("who"),
    )


TEXT_HELPERS = f"""
SELECT event_id, event_type AS plain, event_id || '-' || user_id AS joined, 'hi' AS bytes, event_type || '-' || chr(9) || '.' AS raw,
CASE WHEN cents >= 60000 THEN (cents // 60000) || 'm' || CASE WHEN cents % 60000 // 1000 = 0 THEN '' ELSE cents % 60000 // 1000 || 's' END WHEN cents >= 1000 THEN regexp_replace(printf('%.1f', cents * 1000 / 1e6), '\\.0$', '') || 's' ELSE regexp_replace(printf('%.1f', cents * 1000 / 1e3), '\\.0$', '') || 'ms' END AS took,
'node-n' || user_id AS who FROM {EVENTS}
"""


def routed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the conditions that hold; of none, to the default."""
    out = filters.routes(events(spark, sf_dir), {"errors": F.col("event_type") == "error", "large": F.col("cents") > 10_000})
    parts = [d.select("event_id", F.lit(k).alias("target")) for k, d in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ROUTED_RECORDS = f"SELECT event_id, 'errors' AS target FROM {EVENTS} WHERE event_type = 'error' UNION ALL SELECT event_id, 'large' FROM {EVENTS} WHERE cents > 10000 UNION ALL SELECT event_id, 'default' FROM {EVENTS} WHERE event_type <> 'error' AND cents <= 10000"


def shared_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that all of a type's records share, per-process ones left out."""
    r = F.create_map(F.lit("type"), F.col("event_type"), F.lit("process.pid"), F.lit("1"), F.lit("odd"), F.when(F.col("event_type") == "view", "same").otherwise(F.col("user_id").cast("string")))
    out = processes.common_attributes(events(spark, sf_dir).select("event_type", r.alias("resource")), "event_type")
    return out.select("event_type", F.array_join(F.array_sort(F.map_keys("common")), ",").alias("keys"))


SHARED_ATTRIBUTES = f"SELECT event_type, CASE WHEN event_type = 'view' OR count(DISTINCT user_id) = 1 THEN 'odd,type' ELSE 'type' END AS keys FROM {EVENTS} GROUP BY 1"

QUERIES = {"sensors": sensors, "disks": disks, "chassis": chassis, "control_groups": control_groups, "user_agents": user_agents, "windows_log": windows_log, "text_helpers": text_helpers, "routed_records": routed_records, "shared_attributes": shared_attributes}
ORACLES = {"sensors": SENSORS, "disks": DISKS, "chassis": CHASSIS, "control_groups": CONTROL_GROUPS, "user_agents": USER_AGENTS, "windows_log": WINDOWS_LOG, "text_helpers": TEXT_HELPERS, "routed_records": ROUTED_RECORDS, "shared_attributes": SHARED_ATTRIBUTES}
