import datetime as dt
from collections import Counter

import pytest

from sparkvigil.operators import drift


def profiles(spark, rows):
    """rows: node, key, value, capture (days)."""
    t = dt.datetime(2026, 3, 1)
    return spark.createDataFrame([("c", n, None if d is None else t + dt.timedelta(days=d), k, v) for n, k, v, d in rows], "cluster string, node string, captured_at timestamp, key string, value string")


def plain(rows):
    """Every target against a tally of its siblings."""
    nodes, keys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    held = {(n, k): v or drift.ABSENT for n, k, v, _ in rows}
    out = set()
    for n in nodes:
        for k in keys:
            tally = Counter(held.get((m, k), drift.ABSENT) for m in nodes if m != n)
            value, count = max(tally.items(), key=lambda x: x[1])
            if 2 * count <= len(nodes) - 1:
                out.add((n, k, None))
            elif held.get((n, k), drift.ABSENT) != value:
                out.add((n, k, value))
    return out


def test_majorities(spark):
    rows = [(f"n{i}", k, v, 0) for k, vs in {"a": "xxxxy", "b": "xxyyz", "c": "xxxyy", "d": "xxx", "e": "xxxx "}.items() for i, v in enumerate(v.strip() for v in vs)]
    rows += [(f"n{i}", "f", "x" if i % 2 else "y", 0) for i in range(5)]
    for n in (5, 4):
        some = [r for r in rows if int(r[0][1:]) < n]
        v = drift.verdicts(profiles(spark, some)).filter("expected is null or expected <> observed").collect()
        assert {(r["node"], r["key"], r["expected"]) for r in v} == plain(some)


def test_refused_and_spread(spark):
    p = profiles(spark, [("n1", "k", "v", 0), ("n2", "k", "v", 3), ("n3", "k", "v", None)])
    assert {(r["node"], r["siblings"]) for r in drift.refused(p).collect()} == {("n1", 2), ("n2", 2), ("n3", 2)}
    assert drift.drifts(p).count() == 0
    s = drift.capture_spread(p).first()
    assert s["spread_seconds"] == 3 * 86400 and s["stale"]


def test_drift_events_take_the_newest_capture(spark):
    p = profiles(spark, [(f"n{i}", "k", "x" if i else "y", i) for i in range(5)])
    e = drift.drift_events(p).collect()
    assert [(r["node"], r["ts"], r["detail"]["attrs"]["peer_majority"]) for r in e] == [("n0", dt.datetime(2026, 3, 5), "4")]


def test_compare_profiles(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "key string, value string")
    b = spark.createDataFrame([("x", "2"), ("y", ""), ("w", "9")], "key string, value string")
    got = {(r["key"], r["recorded"], r["probed"]) for r in drift.compare_profiles(a, b, []).collect()}
    assert got == {("x", "1", "2"), ("z", "3", ""), ("w", "", "9")}


def test_yaml_subset():
    from sparkvigil.sources.yamlsub import parse, render

    doc = {"version": "1", "allow": ["drain", "a: b"], "nodes": [], "site": {"os": {"id": "x"}, "list": [{"k": "v", "w": "z"}]}}
    assert parse(render(doc)) == doc
    for bad in ("a: &x 1", "a:\n   b: 1", "a: 1\n\tb: 2", "---\na: 1", "a: 1\na: 2", "- a\nb: 1", "a: [1]", "x"):
        with pytest.raises(ValueError, match="line"):
            parse(bad)


def test_policy(spark, tmp_path):
    from sparkvigil.operators import policy

    r = spark.createDataFrame([("drain", "node-1", ""), ("drain", "", ""), ("reboot", "node-1", ""), ("requeue", "node-1", ""), ("drain", "rack-1", "")], "kind string, node string, job string")
    gates = lambda p, **kw: [x["gate"] for x in policy.evaluate(r, p, **kw).collect()]
    assert gates(policy.Policy()) == ["unknown_action"] * 5
    p = policy.Policy(cluster="a", allow=["drain"], nodes=["node-*"])
    acts = {"drain": "resume", "reboot": "", "requeue": "hold"}
    assert gates(p, cluster="a", actions=acts) == [None, "out_of_scope", "irreversible", "not_allowed", "out_of_scope"]
    assert gates(p, cluster="b", actions=acts)[0] == "wrong_cluster"
    assert policy.Policy.load(str(tmp_path / "none.yaml")) == policy.Policy()
    (tmp_path / "p.yaml").write_text("version: 1\nallow:\n  - drain\nnodes: []\ndry_run: false\n")
    assert policy.Policy.load(str(tmp_path / "p.yaml")).dry_run is False
    log = policy.AuditLog(str(tmp_path / "audit"))
    d = {"kind": "drain", "allowed": True, "dry_run": True, "gate": None}
    assert policy.execute([d], log.record)[0]["executed"] is False and log.last(5)[0][0]["kind"] == "drain"

    def broken(_):
        raise OSError("disk full")

    assert policy.execute([d], broken)[0]["allowed"] is False
