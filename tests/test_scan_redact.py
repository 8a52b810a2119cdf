from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkvigil.operators import redact, scan
from sparkvigil.plans.queries_text import SALT, pseudonyms, reference_pseudonym

FLAG = {
    "ipv4": "from 10.1.2.3 on", "ipv6": "fe80:1:2:3:4:5", "ib-guid": "0x0002c903000a1b2c", "mac": "aa:bb:cc:dd:ee:ff", "email": "mail bob@site.io now", "fqdn": "login1.cs.uni.edu",
    "home-path": "/home/bob/x", "ssh-key": "ssh-rsa AAAAB3NzaC1yc2EAAAADAQAB", "private-key": "-----BEGIN RSA PRIVATE KEY-----", "long-hex": "d41d8cd98f00b204e9800998ecf8427e",
    "uid": "uid=1234", "account-code": "TG-CHE200098", "slurm-conf-host": "NodeName=gpu01",
}
PASS = ["127.0.0.1", "192.0.2.7", "550.54.14.2 999.1.1.1", "0x0000000000000001", "www.example.com", "/home/user-01/x", "uid=0", "uid=90001", "ClusterName=cluster-a", "NodeName=node-[0001-0128]", "0000:c1:00.0", "10.1.2.3 # redaction-ok", "12:30:45"]


def findings(spark, *lines, sup=None):
    d = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    return [tuple(r) for r in scan.scan(scan.lines_of(d), sup).orderBy("line_no", "col", "rule").collect()]


def test_rules(spark):
    got = findings(spark, *FLAG.values())
    for n, rule in enumerate(FLAG, 1):
        assert rule in {g[3] for g in got if g[1] == n}, rule
    assert findings(spark, *PASS) == []


def test_columns_are_bytes(spark):
    got = findings(spark, "é 10.0.0.1, 10.0.0.2", "10.0.0.3")
    assert [(g[1], g[2], g[4]) for g in got] == [(1, 4, "10.0.0.1"), (1, 14, "10.0.0.2"), (2, 1, "10.0.0.3")]


def test_suppressions(spark):
    sup = scan.parse_suppressions(spark, "# list\nipv4 10.0.0.1 # lab\n")
    assert [g[4] for g in findings(spark, "10.0.0.1 10.0.0.2", sup=sup.select("rule", "match"))] == ["10.0.0.2"]
    for bad in ("ipv4 10.0.0.1", "ipv4 10.0.0.1 #", "ipv4 # why", "nope 1 # why"):
        with pytest.raises(ValueError):
            scan.parse_suppressions(spark, bad)


def test_nothing_survives(spark):
    rows = [("host-1", "bob", "/u/bob:x host-1 bobby 10.9.8.7 550.54.14.777"), ("host-12", "al", "host-12 host-1 al /home/alice"), (None, None, None)]
    e = spark.createDataFrame(rows, "node string, u string, p string").select(F.lit("big").alias("cluster"), "node", F.lit("resource.oom").alias("class"), F.struct(F.lit("s").alias("signature"), F.create_map(F.lit("user"), "u", F.lit("cgroup"), "p", F.lit("limit_bytes"), F.lit("10.1.1.1")).alias("attrs")).alias("detail"))
    out = redact.redact_events(e, SALT).collect()
    host = lambda n: reference_pseudonym("host", n)
    user = lambda n: reference_pseudonym("user", n)
    by = {r["node"]: r["detail"]["attrs"] for r in out}
    assert set(by) == {host("host-1"), host("host-12"), None}
    assert by[host("host-1")]["cgroup"] == f"/u/{user('bob')}:x {host('host-1')} {user('bob')}by {reference_pseudonym('addr', '10.9.8.7')} 550.54.14.777"
    assert by[host("host-12")]["cgroup"].startswith(f"{host('host-12')} {host('host-1')} ") and user("alice") in by[host("host-12")]["cgroup"]
    assert by[host("host-1")]["limit_bytes"] == "10.1.1.1" and out[0]["cluster"] == reference_pseudonym("cluster", "big")


def test_collisions_raise(spark):
    pairs = spark.createDataFrame([("host", "a", "node-1"), ("host", "b", "node-1"), ("user", "a", "node-1")], "kind string, original string, pseudonym string")
    with pytest.raises(ValueError, match="collision"):
        redact.checked(pairs)


def test_pseudonyms_of_names_that_collide(spark, tmp_path):
    """Two of these names share eight digits: the mapping has both, a bundle that holds both is refused."""
    names = [f"Supplier#{i:09d}" for i in range(6000)]
    made = {n: reference_pseudonym("host", n) for n in names}
    shared = Counter(made.values())
    both = [n for n in names if shared[made[n]] > 1]
    assert len(both) == 2
    spark.createDataFrame([(n,) for n in names], "s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    assert sorted((r["original"], r["pseudonym"]) for r in pseudonyms(spark, str(tmp_path)).collect()) == sorted(made.items())
    e = spark.createDataFrame([(n,) for n in both], "node string").select(F.lit("big").alias("cluster"), "node", F.lit("resource.oom").alias("class"), F.struct(F.lit("s").alias("signature"), F.create_map(F.lit("user"), F.lit("u")).alias("attrs")).alias("detail"))
    with pytest.raises(ValueError, match="collision"):
        redact.redact_events(e, SALT)
