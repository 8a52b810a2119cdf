import datetime as dt

from pyspark.sql import functions as F

from sparkvigil.operators import report, timeline
from sparkvigil.plans.evidence import events
from test_fleet import profiles

SF = "/root/testdata/sf0.001"
CAPS = "cluster string, source string, name string, level string, available boolean, detail string, reveals string"


def texts(lines):
    return {r["job"]: r["text"].split("\n") for r in report.text(lines).collect()}


def test_context_of_some_jobs(spark):
    e = events(spark, SF)
    some = e.filter("jobid is not null").select("cluster", F.col("jobid.base").alias("job")).orderBy("ordinal").limit(1)
    asked = some.unionByName(spark.createDataFrame([("cluster-a", 10**12)], "cluster string, job long").withColumn("job", F.col("job").cast("decimal(20,0)")))
    caps = spark.createDataFrame([("cluster-a", "gpu", "driver", "root", False, "", None), ("cluster-a", "gpu", "x", "root", True, "", ""), ("other", "gpu", "y", "root", False, "d", "r")], CAPS)
    odd = spark.createDataFrame([("cluster-a", 4), ("cluster-a", None)], "cluster string, n long")
    got = texts(report.context_lines(e, caps, odd, site=report.site_lines({}), limit=0, jobs=asked))
    assert len(got) == 2
    for job, lines in got.items():
        assert lines[0] == f"job {job} on cluster-a" and lines[-3:] == ["NOT SEEN", "  gpu/driver (root)", "4 lines matched no signature"]
        assert ("no events: nothing recorded this job, or no reader could see what did" in lines) == (job == 10**12) and any(x.startswith("SITE no profile") for x in lines)
    assert report.context_lines(e.limit(0), jobs=asked.limit(0)).count() == 0


def test_limits_keep_what_could_not_be_seen(spark):
    e = events(spark, SF)
    whole, cut = (report.context_lines(e, limit=n, cluster_scope=True) for n in (0, 1))
    count = lambda df, s: df.filter(F.col("section") == s).count()
    assert count(whole, report.GAPS) == count(cut, report.GAPS) and count(whole, report.OMITTED) == 0 < count(cut, report.OMITTED)
    kept = cut.filter((F.col("section") == report.TIMELINE) & ~F.col("line").startswith("  ["))
    assert kept.filter(F.substring("line", 12, 1) != timeline.MARKS["direct"]).count() == 0 < kept.count()


def test_site_lines():
    profile = {"cluster": "a", "scheduler": {"kind": "slurm", "version": "24"}, "os": {"id": "alma", "kernel_release": "6"}, "gpu": {"vendor": "nvidia", "models": ["x", "y"]}, "fabric": {"kind": "none"}, "gaps": [{"name": "scheduler"}]}
    got = report.site_lines(profile, "s.yaml")
    assert got[:5] == ["SITE from s.yaml", "  scheduler  slurm 24", "  modules    none active", "  os         alma, kernel 6", "  gpu        nvidia (x, y)"] and len(got) == 6


def test_doctor_of_sources_with_parts_missing(spark):
    caps = spark.createDataFrame([("gpu", "b", None, False, "gone", "cost"), ("gpu", "a", "root", True, None, None)], "source string, name string, level string, available boolean, detail string, reveals string")
    e, w = (spark.createDataFrame([(x,) for x in xs], "source string") for xs in (["slurm", "slurm"], ["slurm"]))
    got = {r["source"]: r["text"].split("\n") for r in report.text(report.doctor_lines(caps, e, w)).collect()}
    assert got == {"gpu": ["gpu", "  ok   a (root)", "  MISS b () gone", "       without it: cost", "  0 events"], "slurm": ["slurm", "  (declares no capabilities)", "  2 events, 1 warnings"]}
    assert report.doctor_lines(caps.limit(0), e.limit(0), w.limit(0)).count() == 0


def test_diff_lines(spark):
    rows = [(f"n{i}", "k", "x" if i else "y", 2 * (i == 4)) for i in range(5)] + [("n0", "o", "1", 0), ("n1", "o", "1", 0)]
    got = {r["node"]: r["text"].split("\n") for r in report.text(report.diff_lines(profiles(spark, rows))).collect()}
    assert got["n0"] == ["node n0 of cluster c", "4 siblings", "captures span 2d: what differs may be when they were read", "DIVERGENCE FROM THE MAJORITY", "  k: y", "    4 of 4 siblings: x", "  o: 1", "    3 of 4 siblings: (absent)"]
    assert got["n3"][3:] == ["no divergence on any key", "NO MAJORITY", "  o"]
    few = {r["node"]: r["text"] for r in report.text(report.diff_lines(profiles(spark, rows[:2]))).collect()}
    assert few["n1"] == "node n1 of cluster c\nnot compared: 1 siblings, 3 are needed"


def test_spread_text(spark):
    rows = [(s,) for s in (0, 89, 3600, 7290, 86399, 86400, 129600, 216000)]
    got = [r[0] for r in spark.createDataFrame(rows, "s long").coalesce(1).select(report.spread_text(F.col("s"))).collect()]
    assert got == ["0m", "1m", "1h0m", "2h2m", "24h0m", "1d", "2d", "2d"] and dt.timedelta(seconds=216000).days == 2
