"""Deterministic pseudonyms for whole bundles: learn identifiers, then rewrite them everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pseudonym import pseudonym
from ..functions.scalars import plausible_ipv4
from .scan import RULES, java
from .validate import identifying

#: Account names in home paths: what stands before, and the name.
HOME = r"(/(?:home|users|u)/)([^/\s:,]+)"
#: A cluster's learned identifiers are sent to all tasks up to so many.
MAX_DICTIONARY = 200_000


def learn(events: DataFrame, clocks: DataFrame | None = None) -> DataFrame:
    """Distinct (kind, original): clusters, nodes (of clocks too), and values of user and account."""
    attrs = F.col("detail")["attrs"]
    pairs = F.array(
        F.struct(F.lit("cluster").alias("kind"), F.col("cluster").alias("original")), F.struct(F.lit("host").alias("kind"), F.col("node").alias("original")),
        F.struct(F.lit("user").alias("kind"), F.try_element_at(attrs, F.lit("user")).alias("original")), F.struct(F.lit("account").alias("kind"), F.try_element_at(attrs, F.lit("account")).alias("original")),
    )
    found = events.select(F.explode(pairs).alias("p")).select("p.kind", "p.original")
    if clocks is not None:
        found = found.unionByName(clocks.select(F.lit("host").alias("kind"), F.col("node").alias("original")))
    return found.filter("coalesce(original, '') <> ''").distinct()


def mapping(identifiers: DataFrame, salt: bytes) -> DataFrame:
    """kind, original, pseudonym."""
    return identifiers.select("kind", "original", pseudonym(salt, F.col("kind"), F.col("original")).alias("pseudonym"))


def collisions(pairs: DataFrame) -> DataFrame:
    """Pseudonyms of a kind that stand for two originals: to be raised, since they would merge two machines."""
    return pairs.groupBy("kind", "pseudonym").agg(F.count_distinct("original").alias("originals")).filter("originals > 1")


def checked(pairs: DataFrame) -> DataFrame:
    clash = collisions(pairs).first()
    if clash:
        raise ValueError(f"pseudonym collision on {clash['pseudonym']}")
    return pairs


def replace_each(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """Every match of the pattern replaced by ``made`` of it: the pieces between, zipped with the replacements."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(made(F.get(found, i)), F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def structural(text: Column, salt: bytes) -> Column:
    """Account names in home paths, then addresses."""
    home = lambda m: F.concat(F.regexp_extract(m, HOME, 1), pseudonym(salt, "user", F.regexp_extract(m, HOME, 2)))
    addr = lambda m: F.when(plausible_ipv4(m), pseudonym(salt, "addr", m)).otherwise(m)
    return replace_each(replace_each(text, java(HOME), home), java(RULES["ipv4"]), addr)


def dictionary(pairs: DataFrame) -> Column:
    """Learned strings as a literal array, longest first, ties by string, then kind; of bounded number."""
    rows = pairs.filter("kind <> 'addr'").limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"over {MAX_DICTIONARY} identifiers in one bundle: redact it by cluster")
    rows.sort(key=lambda r: (-len(r["original"].encode()), r["original"], r["kind"]))
    return F.from_json(F.lit(_json([{"f": r["original"], "t": r["pseudonym"]} for r in rows])), "array<struct<f:string,t:string>>")


def _json(rows: list) -> str:
    import json

    return json.dumps(rows)


def redact_text(text: Column, salt: bytes, words: Column | None = None) -> Column:
    """Structural rewriting, then the learned strings in the dictionary's order, each over the result so far."""
    out = structural(text, salt)
    return out if words is None else F.aggregate(words, out, lambda a, p: F.replace(a, p["f"], p["t"]))


def redact_events(events: DataFrame, salt: bytes, clocks: DataFrame | None = None) -> DataFrame:
    """Cluster, node, user and account by pseudonym; other identifying attrs as text; all else untouched."""
    pairs = checked(mapping(learn(events, clocks), salt))
    words = dictionary(pairs)
    attrs, name = F.col("detail")["attrs"], F.col("class")
    empty = lambda c: F.when(F.coalesce(c, F.lit("")) == "", c)
    made = F.transform_values(attrs, lambda k, v: F.when(~identifying(name, k), v).when(k == "user", pseudonym(salt, "user", v)).when(k == "account", pseudonym(salt, "account", v)).otherwise(redact_text(v, salt, words)))
    return events.withColumns({
        "detail": F.struct(F.col("detail")["signature"].alias("signature"), made.alias("attrs")),
        "cluster": pseudonym(salt, "cluster", F.col("cluster")),
        "node": F.coalesce(empty(F.col("node")), F.when(F.col("node") != "", pseudonym(salt, "host", F.col("node")))),
    })


def redact_clocks(clocks: DataFrame, salt: bytes) -> DataFrame:
    return clocks.withColumn("node", F.when(F.coalesce("node", F.lit("")) != "", pseudonym(salt, "host", F.col("node"))))


def redact_profile(values: DataFrame, salt: bytes, pairs: DataFrame) -> DataFrame:
    """Long-form profiles (cluster, node, key, value) with names and free-form values rewritten."""
    words = dictionary(pairs)
    return values.withColumns({
        "cluster": pseudonym(salt, "cluster", F.col("cluster")), "node": pseudonym(salt, "host", F.col("node")), "value": redact_text(F.col("value"), salt, words),
    })
