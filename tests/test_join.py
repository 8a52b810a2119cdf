import datetime as dt

from pyspark.sql import functions as F

from sparkvigil import schema
from sparkvigil.functions.jobid import parse_job_id
from sparkvigil.operators import encode, join, timeline, validate

T0 = dt.datetime(2026, 3, 4, 9, 0)


def events(spark, rows):
    """rows: minutes, node, job, signature (class unknown)."""
    got = spark.createDataFrame([(T0 + dt.timedelta(minutes=m), n, j, s, i) for i, (m, n, j, s) in enumerate(rows)], "ts timestamp, node string, j string, s string, ordinal long")
    return got.select("ts", F.lit("c").alias("cluster"), "node", parse_job_id(F.col("j")).alias("jobid"), F.lit("journal").alias("source"), F.lit("unknown").alias("class"), F.struct(F.col("s").alias("signature"), F.create_map(F.lit("state"), F.lit("x")).alias("attrs")).alias("detail"), "ordinal")


def related(df):
    return sorted((int(r["job"]), r["relation"], r["ordinal"]) for r in df.collect())


def test_for_jobs(spark):
    e = events(spark, [(0, "n1", "7", "a"), (10, "n1", "7.batch", "b"), (-15, "n1", None, "edge"), (-16, "n1", None, "early"), (15, "n1", None, "late edge"), (16, "n1", None, "late"), (5, "n2", None, "other"), (5, "", None, "whole"), (5, "n1", "8", "other job")])
    got = related(join.for_jobs(e, cluster_scope=True))
    assert [g for g in got if g[0] == 7] == [(7, "cluster", 7), (7, "direct", 0), (7, "direct", 1), (7, "node", 2), (7, "node", 4)]
    assert [g for g in related(join.for_jobs(e, skew=60)) if g[0] == 7 and g[1] == "node"] == [(7, "node", 2), (7, "node", 3), (7, "node", 4), (7, "node", 5)]
    assert [g for g in related(join.for_jobs(e, before=0, after=0)) if g[1] == "node"] == []
    assert related(join.for_jobs(e.filter("jobid is null"))) == []


def test_buckets_give_no_pair_twice(spark):
    e = events(spark, [(0, "n1", "7", "a"), (600, "n1", "7", "b"), *[(m, "n1", None, "x") for m in range(0, 600, 7)]])
    a, b = related(join.for_jobs(e, bucket=60)), related(join.for_jobs(e, bucket=10**6))
    assert a == b and len(set(a)) == len(a)


def test_collapse_keeps_alternation(spark):
    e = events(spark, [(0, "n1", "7", "down"), (1, "n1", "7", "up"), (2, "n1", "7", "down"), (3, "n1", "7", "down")])
    rows = timeline.collapse(join.for_jobs(e)).orderBy("ord").collect()
    assert [(r["signature"], r["count"], r["ord"]) for r in rows] == [("down", 1, 0), ("up", 1, 1), ("down", 2, 2)]


def plain_budget(rows, limit):
    """The rule word by word: render, drop the farthest, render again."""
    def size(kept):
        if not kept:
            return 9
        width = max(len(r["source"]) for r in kept) + max(len(r["class"]) for r in kept)
        return sum(16 + width + len(r["tail"].encode()) for r in kept) + 15 * len({r["ts"].date() for r in kept})

    own = [r["ts"] for r in rows if r["relation"] == "direct"]
    gap = lambda r: max(dt.timedelta(0), min(own) - r["ts"], r["ts"] - max(own))
    drop = sorted((r for r in rows if r["relation"] != "direct"), key=lambda r: (gap(r), r["ord"]), reverse=True)
    kept = list(rows)
    for r in [None, *drop]:
        kept = [k for k in kept if r is None or k["ord"] != r["ord"]]
        if (size(kept) + 3) // 4 <= limit:
            return sorted(k["ord"] for k in kept)
    return sorted(k["ord"] for k in kept)


def test_budget_is_the_plain_rule(spark):
    e = events(spark, [(0, "n1", "7", "own"), (900, "n1", "7", "own again"), *[(m, "n1", None, f"s{m % 5}" * (m % 7 + 1)) for m in range(-14, 904, 31)]])
    rows = timeline.collapse(join.for_jobs(e)).cache()
    told = [r.asDict() for r in rows.withColumn("tail", timeline.tail_text(rows)).collect()]
    for limit in (1, 40, 100, 200, 300, 500, 5000):
        assert sorted(r["ord"] for r in timeline.budget(rows, limit).collect()) == plain_budget(told, limit), limit
    assert timeline.budget(rows, 0).count() == rows.count()


def test_validate_and_encode(spark):
    e = events(spark, [(0, "", "7_[1-2]", "a & <b>"), (1, "n1", None, "é")])
    good, bad = validate.validate(e)
    assert bad.count() == 0
    text = encode.encode_events(good)
    assert text.splitlines()[1] == '  {"ts":"2026-03-04T09:00:00.000000000Z","cluster":"c","jobid":{"raw":"7_[1-2]","base":7,"array_range":"[1-2]"},"source":"journal","class":"unknown","detail":{"signature":"a & <b>","attrs":{"state":"x"}}},'
    assert encode.encode_events(e.repartition(3).orderBy(F.desc("ts"))) == text
    whole = encode.bundle(e, join.assumed_clocks(e), "c", "2026", "2027")
    assert whole.startswith('{"schema_version":2,"cluster":"c","window":{"start":"2026","end":"2027"},"clocks":[{"source":"journal","offset_nanos":0,"method":"assumed_zero"}],"redaction":{"mode":"none"},"events":[\n')
    broken = e.withColumn("class", F.lit("nope"))
    assert [r["reject_reason"] for r in validate.validate(broken)[1].collect()] == ["unknown class"] * 2


def test_decode_round_trip(spark, tmp_path):
    e = events(spark, [(0, "n0", "7_3.batch", "a"), (1, None, None, "b")])
    text = encode.encode_events(e)
    (tmp_path / "e.json").write_text(text)
    assert encode.encode_events(encode.decode_events(spark, str(tmp_path / "e.json"))) == text


def test_registry_is_closed():
    assert len(schema.SOURCES) == 7 and len(schema.CLASSES) == 25 and list(schema.CLASSES) == sorted(schema.CLASSES)
    assert schema.registry()["gpu.xid"]["user"] is True and "shoe_size" not in schema.registry()["unknown"]
