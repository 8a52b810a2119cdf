import datetime as dt
import time

from pyspark.sql import functions as F

from sparkvigil.functions.jobid import parse_job_id
from sparkvigil.sources import accounting, captures, devices, hosts, logs
from sparkvigil.streaming import tail


def lines(spark, text, path="f", name="f.txt", host="h"):
    rows = [(path, name, host, n, x) for n, x in enumerate(text.strip("\n").split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, name string, host string, line_no long, line string")


def test_accounting_pipes(spark):
    text = """JobID|JobName|Partition|Account|AllocCPUS|State|ExitCode|ReqMem|MaxRSS|Timelimit|Elapsed|NodeList|Start|End|User
7|t|gpu|acct-01|16|OUT_OF_MEMORY|0:125|8G||02:00:00|00:11:51|node-0042|2026-03-04T09:02:11|2026-03-04T09:14:02|user-01
7.extern|t||acct-01|16|COMPLETED|0:0||1204K||00:11:51|node-0042|2026-03-04T09:02:11|2026-03-04T09:14:02|
x|t|||||||||||||
8|t|gpu|a|1|FAILED|1:0|||||None assigned||Unknown|u"""
    e, w = accounting.events(lines(spark, text), "c")
    (row,) = e.collect()
    assert (row["node"], row["class"], row["detail"]["signature"], row["jobid"]["raw"]) == ("node-0042", "resource.oom", "slurm.sacct.state.OUT_OF_MEMORY", "7")
    assert row["detail"]["attrs"] == {"state": "OUT_OF_MEMORY", "exit_code": "0:125", "account": "acct-01", "partition": "gpu", "user": "user-01", "limit_bytes": "8589934592"}
    assert [(r["line_no"]) for r in w.orderBy("line_no").collect()] == [4, 5]


def test_accounting_fixed_width(spark):
    text = """       JobID    State ExitCode Elapsed                 End
------------ -------- -------- ------- -------------------
           7 TIMEOUT       0:0 02:00:1 2026-03-04T09:20:56
     7.batch CANCELL+     0:15         2026-03-04T09:20:57"""
    e, w = accounting.events(lines(spark, text), "c", zone="Europe/Berlin")
    got = {r["jobid"]["raw"]: r for r in e.collect()}
    assert got["7"]["class"] == "resource.walltime_exceeded" and got["7.batch"]["class"] == "sched.cancelled" and w.count() == 0
    assert got["7"]["ts"] == dt.datetime(2026, 3, 4, 8, 20, 56)
    assert "elapsed_seconds" not in got["7.batch"]["detail"]["attrs"]
    _, w = accounting.events(lines(spark, "7 FAILED"), "c")
    assert w.count() == 1


def test_logs(spark):
    text = """2026-03-04T09:14:02+0000 n1 kernel: Memory cgroup out of memory: Killed process 31 (py) x
2026-03-04T09:14:02+02:00 n1 slurmstepd[3]: error: Detected 1 oom_kill event in StepId=918273.batch. Some
[2026-03-04T09:00:00.500] error: Nodes node-[01-02] not responding, setting DOWN
2026-03-04T09:14:02Z n1 kernel: NVRM: Xid (PCI:0000:c1:00.0): 79, GPU has fallen off the bus
2026-03-04T09:14:02Z n1 kernel: Lustre: x: Stale file handle
no log line
2026-03-04T09:14:02Z n1 sshd: hello"""
    e, w = logs.events(lines(spark, text), "c", host="ctl", zone="America/New_York")
    got = e.orderBy("ordinal").collect()
    assert [r["detail"]["signature"] for r in got] == ["kernel.memcg.oom_kill", "slurm.slurmstepd.oom_kill_detected", "slurm.slurmctld.node_set_down", "nvidia.xid", "lustre.estale"]
    assert got[1]["jobid"]["raw"] == "918273.batch" and got[1]["ts"] == dt.datetime(2026, 3, 4, 7, 14, 2) and got[1]["detail"]["attrs"] == {"severity": "error"}
    assert got[2]["node"] == "node-[01-02]" and got[2]["ts"] == dt.datetime(2026, 3, 4, 14, 0, 0, 500000)
    assert got[4]["detail"]["attrs"] == {"fs_type": "lustre"}
    assert [tuple(r) for r in w.collect()] == [("unparsed line", 1, 6, "no log line")]


def test_stderr_looks_back_only(spark):
    text = """NCCL INFO comm 0x1 rank 6 nranks 16 busId 1 commId 0xa - Init
[rank6]: Watchdog caught collective operation timeout: WorkNCCL(SeqNum=1, OpType=ALLREDUCE, Timeout(ms)=1800000) ran
[rank7]: Watchdog caught collective operation timeout: WorkNCCL(SeqNum=1, OpType=ALLGATHER, Timeout(ms)=999) ran
NCCL INFO comm 0x1 rank 7 nranks 16 busId 1 commId 0xb - Init
CUDA driver version is insufficient for CUDA runtime version
load cuda/12.4"""
    jobs = spark.createDataFrame([("f", "7", dt.datetime(2026, 3, 4))], "path string, j string, at timestamp").select("path", parse_job_id(F.col("j")).alias("jobid"), "at", F.lit(None).cast("string").alias("node"))
    got = [r["detail"]["attrs"] for r in devices.stderr_events(lines(spark, text), jobs, "c").orderBy("ordinal").collect()]
    assert got == [{"rank": "6", "op": "ALLREDUCE", "timeout_seconds": "1800", "world_size": "16", "comm": "0xa"}, {"rank": "7", "op": "ALLGATHER", "timeout_seconds": "0"}, None]


def test_gpu_snapshot(spark):
    text = """Wed Mar  4 10:51:40 2026
| NVIDIA-SMI 535          Driver Version: 535.104.05   CUDA Version: 12.4      |
|   2  NVIDIA H100 80GB HBM3          On  | 00000000:47:00.0 Off |                    0 |
| N/A   41C    P0             112W / 700W |  73218MiB / 81559MiB |      0%      Default |
|   3  NVIDIA H100 80GB HBM3          On  | 00000000:48:00.0 Off |                    0 |
| N/A   41C    P0             112W / 700W |  100MiB / 81559MiB |      0%      Default |"""
    got = devices.gpu_events(lines(spark, text), "c", "n1").collect()
    assert sorted(r["class"] for r in got) == ["gpu.driver_mismatch", "unknown"]
    assert next(r for r in got if r["class"] != "unknown")["detail"]["attrs"]["gpu_index"] == "2"
    assert devices.gpu_events(lines(spark, text.split("\n", 1)[1]), "c", "n1").count() == 0


def test_ports(spark):
    text = "CA 'mlx5_0'\n\tPort 1:\n\t\tState: Down\n\t\tPhysical state: Polling\n\t\tRate: 10\n\t\tLink layer: InfiniBand\n\tPort 2:\n\t\tState: Active\nCA 'mlx5_1'\n\tPort 1:\n"
    got = devices.ports(lines(spark, text)).orderBy("nr").collect()
    assert [(r["id"], r["summary"], r["healthy"]) for r in got] == [("mlx5_0:1", "Down Polling 10", False), ("mlx5_0:2", "Active", True), ("mlx5_1:1", "", False)]


def test_host_facts(spark):
    files = {
        "os-release": 'NAME=x\nID="rocky"\nVERSION_ID="9.3"', "osrelease": "5.14.0", "cmdline": "BOOT=/v root=UUID ro quiet", "ldd.txt": "ldd (GNU libc) 2.34", "environ.txt": "LMOD_CMD=/x\nMODULEPATH=/b:/a:/b\nSPACK_ROOT=/s",
        "mounts": "s:/x /scratch\\040a lustre rw\nt:/y /scratch\\040a nfs rw\ntmpfs /tmp tmpfs rw", "slurm.conf": "# clustername=no\nclusterName = big # c", "scontrol.txt": "slurm 23.02.7", "mtimes.txt": "munge.key 2026-03-01T23:30:00-02:00",
    }
    df = None
    for name, text in files.items():
        one = lines(spark, text, name=name)
        df = one if df is None else df.unionByName(one)
    site = {r["key"]: r["value"] for r in hosts.discover(df).collect()}
    assert site["os.id"] == "rocky" and site["cluster"] == "big" and site["scheduler.version"] == "23.02.7" and site["modules.roots"] == "/a,/b" and site["builders"] == "spack=/s"
    assert site["os.glibc_version"] == "2.34" and site["mounts"] == "/scratch a(lustre)" and site["scheduler.kind"] == "slurm" and site["modules.kind"] == "lmod"
    node = hosts.capture_profiles(df, "big", "2026-03-04 00:00:00").first()["keys"]
    assert node["munge.key_mtime"] == "2026-03-02" and node["os.kernel_cmdline"] == "BOOT=/v quiet" and node["mount./scratch a"] == "lustre s:/x"


def test_captures():
    assert captures.candidates("/usr/bin/scontrol", ["show", "job", "--x", "a=b"])[0] == "scontrol-show-job.txt"
    assert captures.resolve(["scontrol.txt", "scontrol-show.log"], "scontrol", ["show", "node"]) == "scontrol-show.log"
    names = captures.capture_names({("a", ("x", "1")): b"1", ("a", ("y", "1")): b"2", ("b", ()): b"3"})
    assert sorted(names.values()) == ["a-x.txt", "a-y.txt", "b.txt"]
    assert captures.present(["scontrol-show-job.txt"], "scontrol") and not captures.present(["scontrolx.txt"], "scontrol")


def test_read_lines_and_profiles(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\n\nthree\n")
    got = captures.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["producer"], r["line_no"], r["line"]) for r in got] == [("a", 1, "one"), ("a", 2, ""), ("a", 3, "three")]
    import pytest

    d = tmp_path / "p"
    d.mkdir()
    (d / "n1.json").write_text('{"profile_version": 1, "cluster": "c", "node": "n1", "captured_at": "2026-03-04T00:00:00Z", "keys": {"os.id": "x"}, "probes": []}')
    assert hosts.read_profiles(spark, str(d)).first()["keys"] == {"os.id": "x"}
    (d / "n2.json").write_text('{"profile_version": 1, "node": "n2", "shoe": 9}')
    with pytest.raises(ValueError, match="not a node profile"):
        hosts.read_profiles(spark, str(d))


def test_stream_of_a_log(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.log").write_text("2026-03-04T09:14:02Z n1 kernel: NVRM: Xid (PCI:0000:c1:00.0): 79, x\n" * 3)
    q = tail.counts(tail.log_stream(spark, str(src), "c")).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    time.sleep(0)
    assert [(r["class"], r["n"]) for r in spark.table("counted").collect()] == [("gpu.xid", 3)]
