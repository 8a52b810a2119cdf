import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import scalars as S
from sparkvigil.functions.jobid import job_id_error, parse_job_id
from sparkvigil.functions.pseudonym import pseudonym, salt_id
from sparkvigil.plans.queries_text import reference_pseudonym


def values(spark, made, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", made(F.col("t")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_job_ids(spark):
    good = values(spark, parse_job_id, "12345", " 12345.batch ", "12345_7", "12345_[8-20%4]", "12345+0", "12345_7.batch", "12345_0", "18446744073709551615")
    assert [(int(g["base"]), g["array_task"], g["array_range"], g["het_offset"], g["step"]) for g in good] == [
        (12345, None, None, None, None), (12345, None, None, None, "batch"), (12345, 7, None, None, None), (12345, None, "[8-20%4]", None, None),
        (12345, None, None, 0, None), (12345, 7, None, None, "batch"), (12345, 0, None, None, None), (2**64 - 1, None, None, None, None),
    ]
    bad = ("abc", "12345_", "12345_x", "12345+x", "12345_[8-20", "12345.", "12345_7+1", "", "-1", "18446744073709551616", "1_4294967296", None)
    assert values(spark, parse_job_id, *bad) == [None] * len(bad)
    assert None not in values(spark, job_id_error, *bad)


@pytest.mark.parametrize(("made", "cases"), [
    (S.bytes_of, {"8G": "8589934592", "8190M": "8587837440", "1204K": "1232896", "1.5Gn": "1610612736", "5": "5", "": None, "xG": None}),
    (S.seconds_of, {"02:00:00": "7200", "1-02:03:04": "93784", "05:09.250": "309", "42": "42", "UNLIMITED": None, "1-12:30": "87150", "": None}),
    (S.normalize_state, {"OUT_OF_ME+": "OUT_OF_MEMORY", "CANCELLED by 12": "CANCELLED", "C+": "C+", " FAILED ": "FAILED", "": None, "XYZ+": "XYZ+"}),
    (S.normalize_cmdline, {"b a root=/x rd.md=0 ro": "a b", "  quiet ": "quiet"}),
    (S.truncate_seconds, {"-12.5": "-12", "3": "3", ".5": None, "-.5": None}),
    (S.unescape_mount, {r"/a\040b": "/a b", r"\134040": r"\040"}),
    (S.first_node, {"node-1": "node-1", "node-[1-2]": None, "a,b": None, "None assigned": None, "": None}),
])
def test_scalars(spark, made, cases):
    assert values(spark, made, *cases) == list(cases.values())


def test_versions(spark):
    got = spark.createDataFrame([("535.54.03", "12.2"), ("535.54.2", "12.2"), ("535.104", "12.2"), ("1", "99.9"), ("x.1", "11.8")], "d string, c string")
    assert [r[0] for r in got.select(S.driver_too_old(F.col("d"), F.col("c"))).collect()] == [False, True, False, None, True]


def test_times(spark):
    made = lambda c: S.format_time(S.log_time(c, "Europe/Berlin"))
    got = values(spark, made, "2026-03-04T09:14:01+02:00", "2026-03-04T09:14:01.25-0400", "2026-03-04T09:14:01Z", "2026-03-04T09:14:01", "later")
    assert got == ["2026-03-04T07:14:01.000000000Z", "2026-03-04T13:14:01.250000000Z", "2026-03-04T09:14:01.000000000Z", "2026-03-04T08:14:01.000000000Z", None]
    assert values(spark, lambda c: S.scheduler_time(c), "Unknown", "None", "", "2026-03-04T09:14:02")[:3] == [None] * 3


def test_pseudonyms(spark):
    salt = b"0123456789abcdef"
    names = ["node-a", "é", "", "x" * 200]
    assert values(spark, lambda c: pseudonym(salt, "host", c), *names) == [reference_pseudonym("host", n, salt) for n in names]
    assert values(spark, lambda c: pseudonym(b"k" * 100, "user", c), "a") == [reference_pseudonym("user", "a", b"k" * 100)]
    assert salt_id(salt) != salt_id(b"f" * 16)
    with pytest.raises(ValueError):
        pseudonym(b"short", "host", F.lit("a"))


def test_versions_of_any_length(spark):
    rows = [("1.2.3.4.5", "1.2.3.4.6", True), ("1.2.3.4.6", "1.2.3.4.5", False), ("1.2", "1.2.0.0.0", False), ("1.2", "1.2.0.0.0.1", True), ("1.x.3", "1.0.3", False), (None, "1", None)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", S.version_less(F.col("a"), F.col("b"))).collect())
