"""Journal records: fields of a map body to resource and record attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import levels, maps

#: Journal fields and the attributes they become.
RESOURCE = {"_HOSTNAME": "host.name", "_MACHINE_ID": "host.id", "_PID": "process.pid", "_COMM": "process.command", "_SYSTEMD_UNIT": "service.name"}
RESOURCE_MORE = {
    "_EXE": "process.executable.path", "_CMDLINE": "process.command_line", "_UID": "user.id", "_GID": "user.group.id", "_SYSTEMD_CGROUP": "container.id", "_RUNTIME_SCOPE": "container.runtime",
}
RECORD_MORE = {
    "_BOOT_ID": "boot.id", "_SYSTEMD_SLICE": "systemd.slice", "_SYSTEMD_INVOCATION_ID": "systemd.invocation_id", "_TRANSPORT": "log.source", "SYSLOG_FACILITY": "syslog.facility.code",
    "SYSLOG_IDENTIFIER": "syslog.appname", "SYSLOG_PID": "syslog.procid", "_SELINUX_CONTEXT": "selinux.context", "_CAP_EFFECTIVE": "process.capabilities.effective",
}
INTERNAL = ("_SOURCE_REALTIME_TIMESTAMP", "__CURSOR", "__MONOTONIC_TIMESTAMP", "_STREAM_ID")
GUARDED = ("process.pid", "process.command", "service.name", "container.id")


def priority_level(priority: Column) -> Column:
    p = priority.try_cast("int")
    return F.when(p.between(0, 2), levels.FATAL).when(p == 3, levels.ERROR).when(p == 4, levels.WARN).when(p.between(5, 6), levels.INFO).when(p == 7, levels.DEBUG)


def journald(df: DataFrame, extended: bool = False, keep_fields: bool = False, skip_when_resource_has: tuple[str, ...] = (), fields: str = "fields") -> DataFrame:
    """Records with a map column ``fields`` as journal records; those where it is null are left as they are.

    What a resource already holds is its own: the journal fills only what it
    lacks, and where it has one of ``skip_when_resource_has``, not the guarded
    ones either. extended maps more fields, drops internal ones, and gathers the
    other ``_`` fields as JSON in journald.unknown_fields; keep_fields gathers
    all that no mapping used in journald.fields.
    """
    f = F.col(fields)
    resource = RESOURCE | (RESOURCE_MORE if extended else {})
    record = RECORD_MORE if extended else {}
    res = F.coalesce(F.col("resource"), maps.empty())
    held = F.lit(False)
    for k in skip_when_resource_has:
        held = held | F.coalesce(res[k] != "", F.lit(False))
    take = {}
    for field, attr in resource.items():
        empty = F.coalesce(res[attr], F.lit("")) == ""
        take[attr] = F.when(empty & ~(held if attr in GUARDED else F.lit(False)), f[field])
    mapped = [*resource, *record, "PRIORITY", "MESSAGE"]
    put = {attr: f[field] for field, attr in record.items()}
    if extended:
        unknown = F.map_filter(f, lambda k, _: k.startswith("_") & ~k.isin(*INTERNAL, *mapped))
        put["journald.unknown_fields"] = F.when(F.size(unknown) > 0, F.to_json(unknown))
    if keep_fields:
        rest = F.map_filter(f, lambda k, _: ~k.isin(*mapped, *(INTERNAL if extended else ())))
        put["journald.fields"] = F.when(F.size(rest) > 0, F.to_json(rest))
    level = priority_level(f["PRIORITY"])
    number = F.coalesce(level, F.col("severity_number"))
    own = f.isNotNull()
    return df.withColumns({
        "body": F.when(own, F.coalesce(f["MESSAGE"], F.col("body"))).otherwise(F.col("body")),
        "severity_number": F.when(own, number).otherwise(F.col("severity_number")),
        "severity_text": F.when(own & level.isNotNull(), levels.text(level)).otherwise(F.col("severity_text")),
        "attributes": F.when(own, maps.overwrite(F.col("attributes"), put)).otherwise(F.col("attributes")),
        "resource": F.when(own, maps.overwrite(res, take)).otherwise(F.col("resource")),
    })
