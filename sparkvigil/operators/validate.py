"""Row-level checks of events against the schema's closed vocabulary and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.jobid import parse_job_id
from ..functions.scalars import once


def _keys(pii: bool | None = None) -> Column:
    table = {name: [k for k, p in keys.items() if pii is None or p is pii] for name, keys in S.registry().items()}
    return F.create_map(*[x for name, keys in table.items() for x in (F.lit(name), F.array(*map(F.lit, keys)))])


def allowed(name: Column, key: Column) -> Column:
    """Whether the class may carry the key."""
    return F.coalesce(F.array_contains(F.try_element_at(_keys(), name), key), F.lit(False))


def identifying(name: Column, key: Column) -> Column:
    """Whether the key's values identify someone; an unknown key counts as one that does."""
    return F.coalesce(~F.array_contains(F.try_element_at(_keys(False), name), key), F.lit(True))


def registered_only(name: Column, attrs: Column) -> Column:
    """Attrs that the class may carry and that have a value; none is null."""
    known = F.coalesce(F.try_element_at(_keys(), name), F.array().cast("array<string>"))
    kept = F.map_filter(attrs, lambda k, v: F.array_contains(known, k) & (F.coalesce(v, F.lit("")) != ""))
    return F.when(F.size(kept) > 0, kept)


def reject_reason() -> Column:
    """Why an event is invalid, the first check that fails; null for a valid one."""
    attrs, name = F.col("detail")["attrs"], F.col("class")
    keys = F.sort_array(F.map_keys(F.coalesce(attrs, F.create_map().cast("map<string,string>"))))
    known = F.coalesce(F.try_element_at(_keys(), name), F.array().cast("array<string>"))
    bad = F.get(F.filter(keys, lambda k: ~F.array_contains(known, k) | (F.octet_length(F.try_element_at(attrs, k)) > S.MAX_VALUE_BYTES)), F.lit(0))
    signature, job = F.col("detail")["signature"], F.col("jobid")
    as_read = once(parse_job_id(job["raw"]), lambda j: F.equal_null(j["base"], job["base"]) & F.equal_null(j["array_task"], job["array_task"]) & F.equal_null(j["step"], job["step"]))
    inconsistent = F.when(job.isNotNull() & ~F.coalesce(as_read, F.lit(False)), "inconsistent job id")
    return (
        F.when(F.col("ts").isNull(), "no timestamp")
        .when(F.coalesce("cluster", F.lit("")) == "", "no cluster")
        .when(~F.coalesce(F.col("source").isin(*S.SOURCES), F.lit(False)), "unknown source")
        .when(~F.coalesce(name.isin(*S.CLASSES), F.lit(False)), "unknown class")
        .when(F.coalesce(signature, F.lit("")) == "", "no signature")
        .when(F.octet_length(signature) > S.MAX_SIGNATURE_BYTES, "signature too long")
        .when(F.size(keys) > S.MAX_ATTRS, "too many attrs")
        .otherwise(F.coalesce(once(bad, lambda k: F.concat(F.when(F.array_contains(known, k), "attr too long ").otherwise("unregistered attr "), k)), inconsistent))
    )


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, quarantined ones with their reject_reason)."""
    marked = events.select("*", F.explode(F.array(reject_reason())).alias("reject_reason"))  # made once, whatever is filtered on it
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")
