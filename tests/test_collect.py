import pytest

from sparkvigil.operators import report, sets
from sparkvigil.sources import captures, collect

FILES = {
    "sacct.txt": "551|t|long|acct-9|8|FAILED|1:0|8G|2G|02:00:00|00:30:00|rack-7|2026-07-01T10:00:00|2026-07-01T10:30:00|user-3\nnot-a-job|t|||||||||||||",
    "scontrol-show-job.txt": "JobId=551 JobName=t\n   StdErr=/home/u/run-551.err\n",
    "run-551.err": "starting\nCUDA initialization: the NVIDIA driver on your system is too old: CUDA driver version is insufficient for CUDA runtime version",
    "journalctl.txt": "2026-07-01T10:20:00Z rack-7 kernel: NVRM: Xid (PCI:0000:c1:00): 79, pid=9\n2026-07-01T13:20:00Z rack-7 kernel: NVRM: Xid (PCI:0000:c1:00): 79, pid=9\nwhat is this",
    "slurmd.log": "[2026-07-01T10:25:00.123] error: Munge decode failed: Expired credential",
    "ibstat.txt": "CA 'm0'\n\tPort 1:\n\t\tState: Down",
}


@pytest.fixture
def host(tmp_path):
    folder = tmp_path / "host"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_text(text + "\n")
    return str(folder)


def test_job_bounds_what_is_read(spark, host, tmp_path):
    got = collect.collect(captures.read_lines(spark, host), "north", "rack-7", job=551).staged(str(tmp_path / "stage"))
    rows = [(r["class"], str(r["ts"])[11:19]) for r in got.events.orderBy("ts", "class").collect()]
    assert rows == [("gpu.xid", "10:20:00"), ("auth.munge", "10:25:00"), ("app.nonzero_exit", "10:30:00"), ("gpu.driver_mismatch", "10:30:00")]
    there = {r["name"]: r["available"] for r in got.capabilities.collect()}
    assert there == {"sacct": True, "job-stderr": True, "journalctl": True, "log:slurmd.log": True, "log:slurmctld.log": False, "nvidia-smi": False, "ibstat": True}
    assert sets.capability_report(got.capabilities).filter("source = 'gpu'").first()["missing"] == 1
    assert sorted(r["source"] for r in got.warnings.collect()) == ["journal", "slurm"]
    lines = {r["source"]: r["text"] for r in report.text(report.doctor_lines(got.capabilities, got.events, got.warnings)).collect()}
    assert "  MISS nvidia-smi (unprivileged) not captured\n       without it: " in lines["gpu"] and "  ok   ibstat (unprivileged) 1 port(s), 1 down" in lines["fabric"]


def test_from_captures_to_a_report(spark, host, tmp_path):
    (text,) = [r["text"] for r in report.text(collect.context(spark, host, "north", 551, "rack-7", stage=str(tmp_path / "stage"))).collect()]
    for part in ("job 551 on north", "window 2026-07-01 10:15:00 to 2026-07-01 10:35:00 UTC", "gpu.xid", "NOT SEEN\n  gpu/nvidia-smi (unprivileged): not captured", "2 lines matched no signature"):
        assert part in text


def test_without_the_jobs_window_the_journal_is_capped(spark, host, tmp_path):
    got = collect.collect(captures.read_lines(spark, host), "north", "rack-7", job=999, cap=2).staged(str(tmp_path / "stage"))
    assert sorted((r["class"], str(r["ts"])[11:13]) for r in got.events.collect()) == [("app.nonzero_exit", "10"), ("auth.munge", "10"), ("gpu.xid", "13")]
    assert got.capabilities.filter("name = 'journalctl'").first()["detail"] == "no window, so the last 2 lines were read"


def test_no_captures(spark, host):
    nothing = collect.collect(captures.read_lines(spark, host).limit(0), "north")
    assert nothing.events.count() == 0 and nothing.capabilities.filter("available").count() == 0
