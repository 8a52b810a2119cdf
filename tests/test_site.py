import json
import os

import pytest
from pyspark.sql import functions as F

from sparkvigil.functions.scalars import canonical_time
from sparkvigil.operators import encode, sets
from sparkvigil.sources import hosts, recording, site

PROFILE = {
    "version": 1, "cluster": "north", "scheduler": {"kind": "slurm", "version": "23.11", "partitions": ["long", "short"]}, "builders": [{"kind": "spack", "root": "/s"}],
    "gpu": {"vendor": "nvidia", "dcgm": True}, "mounts": [{"mountpoint": "/w: x", "fstype": "nfs", "source": "s:/w"}], "gaps": [{"name": "bmc", "level": "privileged", "detail": "no tool # here"}],
}


def test_profile_round_trip():
    assert site.decode(site.encode(PROFILE)) == PROFILE
    assert site.decode("cluster: a\nscheduler:\nbuilders: []\n") == {"version": 1, "cluster": "a", "scheduler": {}, "builders": []}
    with pytest.raises(ValueError, match="cluster"):
        site.encode({"version": 1})


def test_profile_tells_all_that_is_wrong():
    with pytest.raises(ValueError) as e:
        site.decode("cluster: a\nshoe: 1\nos:\n  hat: 2\n  id: x\ngpu:\n  dcgm: maybe\nmodules:\n  roots: /a\nmounts:\n  - mountpoint: /m\n    sock: 3\n")
    told = str(e.value).split("\n")
    assert [x.split(":")[0] for x in told] == ["shoe", "modules.roots", "os.hat", "gpu.dcgm", "mounts[0].sock"]
    for text in ("os:\n  id: x\n", "cluster: a\nversion: 9\n", "- a\n"):
        with pytest.raises(ValueError):
            site.decode(text)


def test_sets_of_profiles(tmp_path):
    folder = tmp_path / "sites"
    folder.mkdir()
    with pytest.raises(ValueError, match="no profiles"):
        site.load(str(folder))
    assert site.discovered(str(tmp_path / "none")) == ({}, "")
    (folder / "b.yaml").write_text("cluster: b\n")
    (folder / "note.txt").write_text("{")
    found, place = site.discovered(str(tmp_path / "none"), str(tmp_path))
    assert place == str(folder) and site.profile_for(found)["cluster"] == "b" and site.profile_for({}) == {}
    (folder / "a.yaml").write_text("cluster: a\n")
    both = site.load(str(folder))
    assert list(both) == ["a", "b"] and site.profile_for(both, "a")["cluster"] == "a"
    for name in ("", "c"):
        with pytest.raises(ValueError):
            site.profile_for(both, name)
    (folder / "c.yaml").write_text("cluster: a\n")
    with pytest.raises(ValueError, match="'a' is in"):
        site.load(str(folder))
    assert [site.cluster_name("x", {"cluster": "y"}, "z"), site.cluster_name("", {"cluster": "y"}, "z"), site.cluster_name("", {}, "z"), site.cluster_name()] == ["x", "y", "z", "local"]


def lines(spark, files):
    rows = [(h, n, i, x) for (h, n), text in files.items() for i, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "host string, name string, line_no long, line string")


def test_probes(spark):
    ports = "CA 'm0'\n\tPort 1:\n\t\tState: Active\n\t\tRate: 400\n\t\tLink layer: InfiniBand\nCA 'm1'\n\tPort 1:\n\t\tState: Active\n\t\tRate: 200\n\t\tLink layer: InfiniBand"
    df = lines(spark, {
        ("a", "scontrol.txt"): "slurm 24.05.1", ("a", "slurm.conf"): "ClusterName=north", ("a", "os-release"): "ID=alma", ("a", "osrelease"): "6.1", ("a", "ldd.txt"): "ldd 2.39", ("a", "ibstat.txt"): ports,
        ("a", "prometheus.yml"): "", ("a", "gmond.conf"): "", ("a", "ipmitool.txt"): "", ("b", "os-release"): "ID=alma",
    })
    got = {(r["host"], r["name"]): r for r in hosts.probes(df).collect()}
    assert len(got) == 18 and {n for (h, n), r in got.items() if h == "a" and r["available"]} == {"scheduler", "os", "fabric", "metrics"}
    assert not any(r["available"] for (h, _), r in got.items() if h == "b") and got["a", "metrics"]["detail"] == "prometheus,ganglia" and got["b", "gpu"]["detail"] == "not found"
    facts = {r["key"]: r["value"] for r in hosts.discover(df).filter("host = 'a'").collect()}
    assert facts["fabric.rates"] == "200,400" and facts["scheduler.config_path"] == "/etc/slurm/slurm.conf" and facts["bmc.kind"] == "ipmi"
    gaps = [r.asDict() for (h, _), r in got.items() if h == "a" and not r["available"]]
    profile = site.from_facts(facts, gaps)
    assert site.decode(site.encode(profile)) == profile and profile["fabric"]["hcas"] == ["m0", "m1"] and {g["name"] for g in profile["gaps"]} == {"modules", "builders", "gpu", "mounts", "bmc"}
    assert hosts.probes(df.limit(0)).count() == 0
    assert len(hosts.capture_profiles(df, "north", "2026-01-01 00:00:00").filter("node = 'a'").first()["probes"]) == 9


def test_recording(tmp_path):
    r = recording.Recording()
    r.command("/usr/bin/qtool", ["show", "job", "-j", "5"], b"job")
    r.command("qtool", ["show", "node"], b"node")
    r.command("qtool", ["show", "node"], b"node")
    r.file("/proc/mounts", b"m\n\xff")
    assert r.flush(str(tmp_path)) == ["mounts", "qtool-show-job.txt", "qtool-show-node.txt"]
    r.verify(str(tmp_path))
    assert os.stat(tmp_path / "input" / "mounts").st_mode & 0o777 == 0o600
    (tmp_path / "input" / "mounts").write_bytes(b"other")
    with pytest.raises(ValueError, match="differs"):
        r.verify(str(tmp_path))
    os.remove(tmp_path / "input" / "mounts")
    with pytest.raises(ValueError, match="can't be replayed"):
        r.verify(str(tmp_path))
    for again in (lambda: r.command("qtool", ["show", "node"], b"else"), lambda: r.file("/etc/mounts", b"else")):
        with pytest.raises(ValueError):
            again()


EVENT = '{"ts":"2026-05-06T07:08:09.000000000Z","cluster":"north","node":"n7","jobid":null,"source":"journal","class":"gpu.xid","detail":{"signature":"nvidia.xid","attrs":{"xid":"79"}}}'
META = "id: {id}\ntitle: t\ncluster: north\nsynthetic: {synthetic}\nexpected_classes:\n  - {cls}\nexpected_root_cause: >-\n  A card\n  fell: off.\n\nproducers:\n  - journal\ncapability: root\n"


def incident(root, name, cls="gpu.xid", synthetic="true", extra="", event=EVENT):
    folder = root / name
    (folder / "input").mkdir(parents=True)
    (folder / "expected").mkdir()
    (folder / "input" / "log.txt").write_text("one\ntwo\n")
    (folder / "expected" / "events.json").write_text(f"[\n  {event}\n]\n")
    (folder / "meta.yaml").write_text(META.format(id=name, synthetic=synthetic, cls=cls) + extra)
    return str(folder)


def test_corpus(spark, tmp_path):
    public, private = tmp_path / "public", tmp_path / "private"
    assert recording.next_index(str(public)) == "001"
    folder = incident(public, "001-card")
    incident(private, "007-open", synthetic="false")
    incident(private, "003-seen", synthetic="false", extra="redacted_by: me\nredaction_method: by hand\n")
    corpus, pending = recording.load_corpus(spark, str(public), str(private))
    assert [x["meta"]["id"] for x in corpus] == ["001-card", "003-seen"] and [os.path.basename(x) for x in pending] == ["007-open"]
    assert corpus[0]["meta"]["expected_root_cause"] == "A card fell: off." and [x["meta"]["id"] for x in recording.real(corpus)] == ["003-seen"] and recording.next_index(str(private)) == "008"
    assert recording.inputs(spark, corpus).groupBy("incident").count().orderBy("incident").collect() == [("001-card", 2), ("003-seen", 2)]
    a, b = (x["events"].select("class", F.col("detail.signature").alias("signature")) for x in corpus)
    assert sets.multiset_difference(a, b, ["class", "signature"]).count() == 0
    path = os.path.join(folder, "expected", "events.json")
    assert encode.is_canonical(spark, path)
    with open(path, "a") as f:
        f.write("\n")
    assert not encode.is_canonical(spark, path)
    with pytest.raises(ValueError, match="differ"):
        recording.load(spark, incident(tmp_path / "bad", "001-a", cls="gpu.ecc"))
    with pytest.raises(ValueError, match="unknown keys.*required"):
        recording.load(spark, incident(tmp_path / "bad", "001-b", synthetic="false", extra="shoe: 1\n"))
    with pytest.raises(ValueError, match="among the public"):
        recording.load_corpus(spark, str(private / ".." / "seen") if incident(tmp_path / "seen", "003-x", synthetic="false", extra="redacted_by: me\nredaction_method: m\n") else "")


TIMES = {
    "2026-05-06T07:08:09.123456789Z": "2026-05-06T07:08:09.123456", "2026-05-06T09:08:09+02:00": "2026-05-06T07:08:09.000000", "2026-05-06T07:08:09": "2026-05-06T07:08:09.000000",
    " 2026-05-06 07:08:09 ": "2026-05-06T07:08:09.000000", "2026-05-06": "2026-05-06T00:00:00.000000",
}


def test_times_and_misses(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t in [*TIMES, "soon", None]], "t string").select("t", canonical_time(F.col("t")).alias("c"))
    got = {r["t"]: r["c"] for r in rows.collect()}
    assert {t: got[t][:26] for t in TIMES} == TIMES and got["soon"] == "soon" and got[None] is None
    path = tmp_path / "log" / "miss.jsonl"
    for t in [*TIMES, "soon", "2026-99-99"]:
        hosts.append_miss(str(path), t, "north", "no-event", note='a "b"')
    when = [json.loads(x)["when"] for x in path.read_text().splitlines()]
    assert [x[:26] for x in when[:5]] == list(TIMES.values()) and when[0].endswith("123456789Z") and when[5:] == ["soon", "2026-99-99"]
    with open(path, "a") as f:
        f.write("{broken\n\n")
    good, bad = hosts.read_misses(spark, str(path))
    assert good.count() == 7 and [r[0] for r in bad.collect()] == ["{broken"]
    assert sets.miss_counts(good).filter("kind is null").first()["n"] == 7
