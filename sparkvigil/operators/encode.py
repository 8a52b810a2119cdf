"""Canonical, byte-stable text of events, bundles and node profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import format_time, nonempty
from .join import canonical_order
from .validate import validate


def _members(*fields: Column) -> Column:
    """A struct's members as JSON text without braces; null members are left out."""
    text = F.to_json(F.struct(*fields))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def job_json(job: Column) -> Column:
    body = F.to_json(F.struct(job["raw"].alias("raw"), job["base"].alias("base"), job["array_task"].alias("array_task"), job["array_range"].alias("array_range"), job["het_offset"].alias("het_offset"), job["step"].alias("step")))
    return F.when(job.isNull(), "null").otherwise(body)


def event_json() -> Column:
    """Field order ts, cluster, node, jobid, source, class, detail; node and attrs only where there are any."""
    attrs = F.col("detail")["attrs"]
    ordered = F.when(F.size(attrs) > 0, F.map_from_entries(F.sort_array(F.map_entries(attrs))))
    head = _members(format_time(F.col("ts")).alias("ts"), F.col("cluster"), nonempty(F.col("node")).alias("node"))
    tail = _members(F.col("source"), F.col("class"), F.struct(F.col("detail")["signature"].alias("signature"), ordered.alias("attrs")).alias("detail"))
    return F.concat(F.lit("{"), head, F.lit(',"jobid":'), job_json(F.col("jobid")), F.lit(","), tail, F.lit("}"))


def encoded(events: DataFrame) -> DataFrame:
    """line: the events' canonical JSON in canonical order."""
    return events.orderBy(*canonical_order()).select(event_json().alias("line"))


def encode_events(events: DataFrame) -> str:
    """The canonical file of a bounded set of events, such as one job's; invalid events raise."""
    bad = validate(events)[1].select("reject_reason").first()
    if bad:
        raise ValueError(f"invalid event: {bad[0]}")
    rows = [r[0] for r in encoded(events).collect()]
    return "[\n" + "".join(f"  {x}{',' if i + 1 < len(rows) else ''}\n" for i, x in enumerate(rows)) + "]\n"


def write_events(events: DataFrame, path: str) -> None:
    """Canonical JSON lines of any number of events, range-sorted, one event a line."""
    encoded(events).write.text(path)


def bundle(events: DataFrame, clocks: DataFrame, cluster: str, lo: str, hi: str, mode: str = "none", salt_id: str = "") -> str:
    """A self-describing result: header, clocks by source and node, events. lo and hi are canonical times."""
    if not cluster or lo > hi or mode not in ("none", "pseudonymize"):
        raise ValueError("a bundle needs a cluster, a window that isn't reversed, and a known redaction mode")
    offsets = []
    for r in clocks.orderBy("source", F.coalesce("node", F.lit(""))).collect():
        node = {"node": r["node"]} if r["node"] else {}
        offsets.append({"source": r["source"], **node, "offset_nanos": r["offset_nanos"], "method": r["method"]})
    redaction = {"mode": mode} | ({"salt_id": salt_id} if salt_id else {})
    head = {"schema_version": S.VERSION, "cluster": cluster, "window": {"start": lo, "end": hi}, "clocks": offsets, "redaction": redaction}
    body = encode_events(events)
    return json.dumps(head, separators=(",", ":"), ensure_ascii=False)[:-1] + ',"events":' + body + "}\n"


def decode_events(spark, path: str) -> DataFrame:
    """Events of a canonical file (one per line, in an array); unknown members and invalid events raise."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    text = F.regexp_replace(F.trim("value"), ",$", "")
    shape = "ts string, cluster string, node string, jobid struct<raw:string,base:decimal(20,0),array_task:bigint,array_range:string,het_offset:bigint,step:string>, source string, class string, detail struct<signature:string,attrs:map<string,string>>"
    got = lines.select(F.from_json(text, shape, {"mode": "FAILFAST"}).alias("e"), F.json_object_keys(text).alias("k"))
    known = ["ts", "cluster", "node", "jobid", "source", "class", "detail"]
    odd = got.filter(F.size(F.array_except("k", F.array(*map(F.lit, known)))) > 0).select("k").first()
    if odd:
        raise ValueError(f"unknown members in {odd[0]}")
    out = got.select(F.try_to_timestamp(F.col("e.ts"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS'Z'")).alias("ts"), "e.cluster", "e.node", "e.jobid", "e.source", "e.class", "e.detail").withColumn("ordinal", F.monotonically_increasing_id())
    bad = validate(out)[1].select("reject_reason").first()
    if bad:
        raise ValueError(f"invalid event: {bad[0]}")
    return out


def is_canonical(spark, path: str) -> bool:
    """Whether a file is, byte for byte, what encode_events makes of the events in it; one that can't be read raises."""
    with open(path, encoding="utf-8", newline="") as f:
        return f.read() == encode_events(decode_events(spark, path))


def profile_json() -> Column:
    """A node profile with sorted keys."""
    return F.to_json(F.struct("profile_version", "cluster", "node", format_time(F.col("captured_at")).alias("captured_at"), F.map_from_entries(F.array_sort(F.map_entries("keys"))).alias("keys"), F.array_sort("probes").alias("probes")))
