"""Storage documents of a management service that link to each other: storages, controllers, drives and volumes by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import maps
from lumenloom.operators.hardware import RANKS, state_rank

#: States by a document's health.
STATES = {"OK": "ok", "ok": "ok", "Warning": "degraded", "Critical": "failed"}
_LINK = "struct<`@odata.id`:string>"
_OWN = "`@odata.id`:string,Id:string,MemberId:string,Name:string,Model:string,FirmwareVersion:string,Revision:string,SerialNumber:string,MediaType:string,Protocol:string,RAIDType:string,CapacityBytes:double,SpeedGbps:double,PredictedMediaLifeLeftPercent:double,FailurePredicted:boolean,Status:struct<Health:string,State:string>"
_PART = f"struct<{_OWN}>"
_DOCUMENT = f"struct<{_OWN},StorageControllers:array<{_PART}>,Drives:array<{_PART}>>"
_LINKS = f"struct<`@odata.id`:string,Id:string,Controllers:{_LINK},Volumes:{_LINK},StorageControllers:array<{_LINK}>>"
#: The fields of a part, in their order, by the columns that hold them.
_FIELDS = {
    "own_link": "@odata.id", "own_id": "Id", "member_id": "MemberId", "own_name": "Name", "model": "Model", "firmware": "FirmwareVersion", "revision": "Revision", "serial": "SerialNumber", "media": "MediaType", "protocol": "Protocol", "raid": "RAIDType",
    "capacity": "CapacityBytes", "speed_gbps": "SpeedGbps", "life_left": "PredictedMediaLifeLeftPercent", "predicted": "FailurePredicted", "status": "Status",
}
#: What tells a part that a list holds from a link to one.
_HELD = ("Status", "CapacityBytes", "Model", "MediaType", "Protocol", "Id", "Name")


def _link(part: Column) -> Column:
    return F.substring_index(part["@odata.id"], "?", 1)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _last(path: Column) -> Column:
    return _filled(F.substring_index(path, "/", -1))


def _parsed(df: DataFrame, kind: str) -> DataFrame:
    """``doc`` in place of ``text``; null for what is no JSON object. A text is read again only if some of it does not fit ``kind``."""
    read = maps.once(df, {"doc": F.from_json("text", f"{kind[:-1]},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})})
    sound = F.col("doc._bad").isNull() | F.json_object_keys("text").isNotNull()
    return read.withColumn("doc", F.when(sound, F.col("doc"))).drop("text")


def _follow(links: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """Adds ``text``, the document of the same host at ``to``; null where there is none, or where it lies outside of ``root``.

    Rows without such a link are dealt by what they hold, under keys that no document has.
    """
    to = F.col("to")
    inside = F.coalesce((to == root) | (to.startswith(f"{root}/") & ~to.contains("..") & ~to.rlike(r"[\\\r\n]")), F.lit(False))
    others = [F.col(c).cast("string") for c in ("to", "storage", "kind", "place") if c in links.columns]
    keyed = links.withColumn("_at", F.when(inside, to).otherwise(F.concat_ws("\n", F.lit(""), *others)))
    return keyed.join(documents.select("host", F.col("path").alias("_at"), "text"), ["host", "_at"], "left").drop("_at")


def storage_parts(df: DataFrame, root: str, host: str = "host", path: str = "path", document: str = "value") -> DataFrame:
    """A row per storage and part that the documents of a host lead to, from the collection at ``root`` on.

    host, storage, kind (storage, controller, drive, volume), id, found, name,
    model, firmware, serial, raid, state (null: not told), capacity, speed_gbps,
    endurance (share of life left), predicted (failure foretold) and drives
    (listed, for a storage with such a list). A list may hold a part or link to
    it. Controllers are those that the storage lists, or else those of the linked
    collection; one without an id has the storage's if it is alone in the list,
    or its MemberId or place. What is linked but not there, not JSON, or without an
    id has found = false; absent parts are left out, an absent storage's parts
    are not. Of several documents of one path the greatest text counts. Three
    joins by host and path follow the links, whatever their number. Each reads
    the documents as texts, so that all three share one shuffle of them, and what
    a join finds is parsed behind it.
    """
    # A name that is there gets no alias: Spark drops it in one of two readers, and they no longer share a shuffle.
    read = df.select(F.col(host) if host == "host" else F.col(host).alias("host"), F.substring_index(F.col(path), "?", 1).alias("path"), F.col(document).alias("text")).where("host IS NOT NULL")
    documents = read.where((F.col("path") == root) | F.col("path").startswith(f"{root}/")).groupBy("host", "path").agg(F.max("text").alias("text"))
    members = _parsed(documents.where(F.col("path") == root), f"struct<Members:array<{_LINK}>>").select("host", F.explode("doc.Members").alias("m"))
    # The texts of storages are shuffled, as both readers below begin there.
    storages = _follow(members.select("host", _link(F.col("m")).alias("to")).distinct(), documents, root).repartition("host", "to")
    named = F.coalesce(_filled(F.col("doc.Id")), _last(F.col("doc.`@odata.id`")), _last(F.col("to")))
    links, storages = (_parsed(storages, kind).withColumn("storage", named) for kind in (_LINKS, _DOCUMENT))

    listed = F.coalesce(F.size("doc.StorageControllers"), F.lit(0)) > 0
    collections = F.array(
        F.struct(F.lit("controller").alias("kind"), F.when(~listed, _link(F.col("doc.Controllers"))).alias("to")),
        F.struct(F.lit("volume").alias("kind"), _link(F.col("doc.Volumes")).alias("to")),
    )
    linked = _follow(links.select("host", "storage", F.inline(collections)).where("to IS NOT NULL"), documents, root)
    linked = _parsed(linked, f"struct<Members:array<{_PART}>>")
    listing = F.coalesce(F.col("doc.Members"), F.array(F.lit(None).cast(_PART)))
    entry = lambda kind, place, of, drives, part: F.struct(F.lit(kind).alias("kind"), place.alias("place"), of.alias("of"), drives.alias("drives"), part.alias("part"))
    none = F.lit(None).cast("int")
    own = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast(f"array<{_PART}>")), lambda x, i: entry(kind, i, F.size(c), none, x))
    doc = F.col("doc")
    whole = F.when(doc.isNotNull(), F.struct(*[doc[f].alias(f) for f in _FIELDS.values()])).cast(_PART)
    entries = storages.select("host", "storage", F.inline(F.concat(F.array(entry("storage", F.lit(0), F.lit(0), F.size("doc.Drives"), whole)), own("controller", "doc.StorageControllers"), own("drive", "doc.Drives"))))
    entries = entries.unionByName(linked.select("host", "storage", "kind", F.lit(0).alias("of"), none.alias("drives"), F.posexplode(listing).alias("place", "part")))

    part, kind = F.col("part"), F.col("kind")
    held = (kind == "storage") | ((kind == "controller") & (F.col("of") > 0))
    for name in _HELD:
        held = held | part[name].isNotNull()
    held = F.coalesce(held, F.lit(False))
    flat = [part[f].alias(c) for c, f in _FIELDS.items()]
    entries = entries.select("host", "storage", "kind", "place", "of", "drives", held.alias("held"), part.isNotNull().alias("there"), F.when(~held, _link(part)).alias("to"), *flat)
    led = _follow(entries, documents, root)
    led = _parsed(led, _PART)
    p = {c: F.when(F.col("held"), F.col(c)).otherwise(doc[f]) for c, f in _FIELDS.items()}
    there = F.when(F.col("held"), F.col("there")).otherwise(doc.isNotNull())
    controller = F.coalesce(F.when(F.col("of") == 1, F.col("storage")), _filled(p["member_id"]), F.when(there, F.col("place").cast("string")))
    named = F.when(kind == "controller", controller).otherwise(_last(F.coalesce(p["own_link"], F.col("to"))))
    id_ = F.when(kind == "storage", F.col("storage")).otherwise(F.coalesce(_filled(p["own_id"]), named, _last(F.col("to"))))
    return led.where(~p["status"]["State"].eqNullSafe(F.lit("Absent"))).select(
        "host", "storage", "kind", id_.alias("id"), (there & id_.isNotNull()).alias("found"), F.coalesce(_filled(p["own_name"]), id_).alias("name"), p["model"].alias("model"),
        F.coalesce(p["firmware"], p["revision"]).alias("firmware"), p["serial"].alias("serial"), p["raid"].alias("raid"), maps.lookup(p["status"]["Health"], STATES).alias("state"),
        p["capacity"].alias("capacity"), p["speed_gbps"].alias("speed_gbps"), (1 - p["life_left"] / 100).alias("endurance"), p["predicted"].alias("predicted"), "drives",
    )


def storage_health(parts: DataFrame) -> DataFrame:
    """host, storage, worst state of the storage and its parts (null: none told), n_parts found, n_missing, and drive_bytes, their drives' capacity."""
    counted = parts.groupBy("host", "storage").agg(
        F.count_if((F.col("kind") != "storage") & F.col("found")).alias("n_parts"),
        F.count_if(~F.col("found")).alias("n_missing"),
        F.sum(F.when(F.col("kind") == "drive", F.col("capacity"))).alias("drive_bytes"),
        F.max(state_rank(F.col("state"))).alias("worst"),
    )
    return counted.withColumn("worst", F.get(F.array(*map(F.lit, RANKS)), F.col("worst")))
