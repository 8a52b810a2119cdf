"""Job ids: ``base [_task | _[mask] | +het] [.step]`` as one regular expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import once, strip

U64, U32 = 2**64 - 1, 2**32 - 1
#: base, array suffix, heterogeneous offset, step (after the last dot outside brackets; no dot inside).
PATTERN = r"^(\d+)(?:_(\d+|\[[^\]]*\])|\+(\d+))?(?:\.([^.\[\]]+))?$"


def _part(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, PATTERN, group), F.lit(""))


def parse_job_id(raw: Column) -> Column:
    """Struct (raw, base, array_task, array_range, het_offset, step), null where the text isn't a job id."""
    def made(p: Column) -> Column:
        number = lambda c: c.try_cast("decimal(38,0)")
        mask = p["suffix"].startswith("[")
        task = number(F.when(~mask, p["suffix"]))
        ok = (number(p["base"]) <= F.lit(str(U64)).cast("decimal(38,0)")) & (F.coalesce(task, F.lit(0)) <= U32) & (F.coalesce(number(p["het"]), F.lit(0)) <= U32)
        return F.when(ok, F.struct(
            p["raw"].alias("raw"), number(p["base"]).cast("decimal(20,0)").alias("base"), task.cast("long").alias("array_task"),
            F.when(mask, p["suffix"]).alias("array_range"), number(p["het"]).cast("long").alias("het_offset"), p["step"].alias("step"),
        ))

    def split(text: Column) -> Column:
        return F.when(text.rlike(PATTERN), F.struct(text.alias("raw"), _part(text, 1).alias("base"), _part(text, 2).alias("suffix"), _part(text, 3).alias("het"), _part(text, 4).alias("step")))

    return once(once(strip(raw), split), made)


def job_id_error(raw: Column) -> Column:
    """Why a text isn't a job id: null where it is."""
    return once(strip(F.coalesce(raw, F.lit(""))), _error)


def _error(text: Column) -> Column:
    return (
        F.when(text == "", "empty")
        .when(text.rlike(r"\.$"), "empty step")
        .when(text.rlike(r"^[^.]*_.*\+|^[^.]*\+.*_"), "both array and heterogeneous")
        .when(text.rlike(r"^[^.]*_(\.|$)"), "empty array suffix")
        .when(text.rlike(r"_\[[^\]]*$"), "unterminated mask")
        .when(parse_job_id(text).isNull(), "not numeric")
    )


def same_job(a: Column, b: Column) -> Column:
    """Equal base, both present: null semantics of = give just that."""
    return a["base"] == b["base"]


def is_step(job: Column) -> Column:
    return F.coalesce(job["step"].isNotNull(), F.lit(False))
