"""One record form for several dozen log formats."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import levels, maps
from lumenloom.operators.logshape import attributes as a
from lumenloom.operators.logshape import devices as d
from lumenloom.operators.logshape import lines as x
from lumenloom.operators.logshape import objects as o
from lumenloom.operators.logshape.core import Branch, claimed_by, flatten, record, shaped

#: Fixed order: the first branch that claims a record shapes it.
BRANCHES: tuple[Branch, ...] = (
    a.FLOW_BRANCH, x.KLOG_BRANCH, x.UVICORN_BRANCH, o.COLLECTOR_BRANCH, o.MONGOD_BRANCH, o.GCPJSON_BRANCH, o.TRACING_BRANCH, o.PINO_BRANCH, o.LOGRUS_BRANCH,
    x.POSTGRES_BRANCH, x.REDIS_BRANCH, x.NGINX_BRANCH, x.SENTRY_BRANCH, d.CISCO_BRANCH, d.SYSLOG_BRANCH, x.INFLUX_BRANCH, x.OAUTH_BRANCH, x.COREDNS_BRANCH,
    a.GCPLB_BRANCH, a.AWSELB_BRANCH, a.S3_BRANCH, a.GCPAUDIT_BRANCH, o.EKS_BRANCH, a.CLOUDTRAIL_BRANCH, x.RABBIT_BRANCH, x.MOSQUITTO_BRANCH, x.STALL_BRANCH,
    x.KAUDIT_BRANCH, x.SMARTD_BRANCH, x.GOCD_BRANCH, x.CRON_BRANCH, a.OPENVPN_BRANCH, a.PBS_BRANCH, a.PVE_BRANCH, a.CONSOLE_BRANCH, x.LOGFMT_BRANCH,
    x.CLICKHOUSE_BRANCH, x.CALICO_BRANCH, x.SSM_BRANCH, x.LITELLM_BRANCH, a.STDERR_BRANCH, o.LLDPD_BRANCH, o.K8S_BRANCH,
)
BY_NAME = {b.name: b for b in BRANCHES}


def logshape(df: DataFrame, branches: Sequence[str] | None = None, options: dict | None = None) -> DataFrame:
    """``df`` with every claimed record shaped, and ``branch``, the branch that did it (null: none, and nothing is changed).

    A syslog line's inner text goes through the other branches once more, on top
    of what the syslog branch found; its record then counts as the inner branch's.
    options: keep_original, prefix, account_aliases, klog_year, klog_levels,
    static_pod_prefixes, static_pod_nodes, gcp_lb_error_values, syslog_source,
    cisco_source, access_point_downgrade, service_name_overrides, hints
    (branch -> {service, scope, source}, all of which must equal the record's).
    Null bodies count as empty; a record without attributes or resource gets empty maps.
    """
    options = options or {}
    unknown = set(branches or ()) - set(BY_NAME)
    if unknown:
        raise ValueError(f"unknown branches: {sorted(unknown)}")
    chosen = [_hinted(b, options) for b in BRANCHES if branches is None or b.name in branches]
    by_name = [b.name for b in chosen]
    if "syslog" in by_name and len(chosen) > 1:
        at = by_name.index("syslog")
        out = _with_inner(df, chosen[:at], chosen[at], chosen[:at] + chosen[at + 1 :], options)
    else:
        out = flatten(shaped(df, chosen, options))
    names = options.get("service_name_overrides", {})
    if names:
        service = F.col("resource")["service.name"]
        new = F.lit(None).cast("string")
        for k, v in names.items():
            new = F.when((service == k) & F.col("branch").isNotNull(), v).otherwise(new)
        out = out.withColumn("resource", maps.overwrite(F.col("resource"), {"service.name": new}))
    return out


def _hinted(b: Branch, options: dict) -> Branch:
    hint = options.get("hints", {}).get(b.name)
    if not hint:
        return b

    def claim(rec):
        ok = b.claim(rec) if b.claim else F.lit(True)
        if "service" in hint:
            ok = ok & (rec.r("service.name") == hint["service"])
        if "source" in hint:
            ok = ok & (rec.source() == hint["source"])
        if "scope" in hint:
            ok = ok & (F.col("scope_name") == hint["scope"])
        return ok

    return replace(b, claim=claim)


def _with_inner(df: DataFrame, before: Sequence[Branch], syslog: Branch, others: Sequence[Branch], options: dict) -> DataFrame:
    """Syslog lines that no branch before claims are unwrapped; then each record, or its inner text, goes through the others once."""
    free = claimed_by(record(df, options), before).isNull() if before else F.lit(True)
    outer = flatten(shaped(df, [syslog], options, only=free)).withColumnRenamed("branch", "_outer")
    inner = F.col("_outer") == "syslog"
    # The attributes that only outer lines are known by are hidden meanwhile.
    hidden = ["message", "priority", options.get("cisco_source", "log.record.original")]
    outer = outer.withColumn("_hidden", F.when(inner, maps.only(F.col("attributes"), hidden)))
    outer = outer.withColumn("attributes", F.when(inner, maps.without(F.col("attributes"), hidden)).otherwise(F.col("attributes")))
    out = flatten(shaped(outer, others, options), keep=("_outer", "_hidden"))
    attributes = F.when(F.col("_outer") == "syslog", maps.merge(F.col("attributes"), F.col("_hidden"))).otherwise(F.col("attributes"))
    return out.withColumns({"branch": F.coalesce("branch", "_outer"), "attributes": attributes}).drop("_outer", "_hidden")


def claims(df: DataFrame, options: dict | None = None) -> DataFrame:
    """``df`` with the name of the branch that claims each record, without shaping it."""
    return df.withColumn("branch", claimed_by(record(df, options), BRANCHES))


def shape_counters(shaped_df: DataFrame) -> DataFrame:
    """Records per branch and source; a null branch counts those no branch claimed."""
    return shaped_df.groupBy("branch", F.coalesce(F.col("attributes")["log.source"], F.lit("none")).alias("source")).agg(F.count("*").alias("records"))
