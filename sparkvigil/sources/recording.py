"""Recording of reads as captures that replay, and a corpus of recorded incidents with what they must give."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.encode import decode_events
from . import captures, yamlsub

INPUT, EXPECTED, META = "input", os.path.join("expected", "events.json"), "meta.yaml"
CAPABILITIES = ("unprivileged", "root")
MEMBERS = (
    "id", "title", "cluster", "synthetic", "expected_classes", "expected_root_cause", "incident", "producers", "capability", "scheduler",
    "redacted_by", "redaction_method", "notes",
)


class Recording:
    """Reads that gave something, kept in memory until they are flushed. Reads that failed are not evidence of emptiness
    and are not recorded."""

    def __init__(self):
        self.commands: dict[tuple[str, tuple[str, ...]], bytes] = {}
        self.files: dict[str, bytes] = {}

    def command(self, name: str, args: list[str], out: bytes) -> bytes:
        key = (name, tuple(args))
        if self.commands.setdefault(key, out) != out:
            raise ValueError(f"{name} {' '.join(args)} gave two results; a capture holds one")
        return out

    def file(self, path: str, out: bytes) -> bytes:
        if self.files.setdefault(os.path.basename(path), out) != out:
            raise ValueError(f"two files named {os.path.basename(path)} differ; a capture holds one")
        return out

    def flush(self, folder: str) -> list[str]:
        """Writes the captures for their owner alone, and returns their names, sorted."""
        held = dict(self.files)
        for key, name in captures.capture_names(self.commands).items():
            if held.setdefault(name, self.commands[key]) != self.commands[key]:
                raise ValueError(f"a command and another read are both named {name}")
        os.makedirs(os.path.join(folder, INPUT), mode=0o700, exist_ok=True)
        for name, out in held.items():
            fd = os.open(os.path.join(folder, INPUT, name), os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
            with os.fdopen(fd, "wb") as f:
                f.write(out)
        return sorted(held)

    def verify(self, folder: str) -> None:
        """Replays every read from what was written; one that is not found or differs raises."""
        names = sorted(os.listdir(os.path.join(folder, INPUT)))
        wanted = [(f"{n} {' '.join(a)}", captures.resolve(names, n, list(a)), out) for (n, a), out in self.commands.items()]
        for what, name, out in wanted + [(p, captures.resolve_file(names, p), out) for p, out in self.files.items()]:
            if name is None:
                raise ValueError(f"{what} was recorded and can't be replayed")
            with open(os.path.join(folder, INPUT, name), "rb") as f:
                if f.read() != out:
                    raise ValueError(f"the replay of {what} differs")


def _meta(folder: str) -> dict:
    """The incident's facts. Text folded over indented lines (``>-``, ``>``, ``|``) is joined first."""
    out: list[str] = []
    fold: tuple[str, list[str]] | None = None
    with open(os.path.join(folder, META), encoding="utf-8") as f:
        for line in [*f.read().split("\n"), "end:"]:
            if fold and (not line.strip() or line.startswith(" ")):
                fold[1].append(line.strip())
                continue
            if fold:
                out.append(f"{fold[0]}: " + yamlsub.quote(" ".join(x for x in fold[1] if x)))
                fold = None
            start = re.match(r"(\w+): *[>|]-?$", line)
            if start:
                fold = (start[1], [])
            elif line != "end:":
                out.append(line)
    return yamlsub.parse("\n".join(out))


def in_progress(folder: str) -> bool:
    """An observed incident that nobody has signed as redacted: it is named and not loaded."""
    try:
        meta = _meta(folder)
    except (OSError, ValueError):
        return False
    return meta.get("synthetic") != "true" and not str(meta.get("redacted_by") or "").strip()


def load(spark: SparkSession, folder: str) -> dict:
    """One incident: meta, inputs (names), events (DataFrame) and folder; what its meta says must hold for its events."""
    meta, name = _meta(folder), os.path.basename(os.path.normpath(folder))
    inputs = sorted(n for n in os.listdir(os.path.join(folder, INPUT)) if os.path.isfile(os.path.join(folder, INPUT, n)))
    events = decode_events(spark, os.path.join(folder, EXPECTED))
    found = events.agg(F.collect_set("class").alias("classes"), F.collect_set("source").alias("sources")).first()
    declared, producers = set(meta.get("expected_classes") or []), set(meta.get("producers") or [])
    real = meta.get("synthetic") != "true"
    incident = meta.get("incident") or {}
    rules = [
        (set(meta) <= set(MEMBERS), f"unknown keys {sorted(set(meta) - set(MEMBERS))}"), (meta.get("id") == name, f"id {meta.get('id')!r} is not the folder's name"),
        *[(bool(meta.get(k)), f"{k} is empty") for k in ("title", "cluster", "expected_root_cause")], (meta.get("capability") in CAPABILITIES, f"capability {meta.get('capability')!r}"),
        (not incident.get("job") or re.match(r"\d", incident["job"]) is not None, f"job {incident.get('job')!r}"), (bool(inputs), "no input"),
        *[(not real or bool(meta.get(k)), f"{k} is required of an observed incident") for k in ("redacted_by", "redaction_method")],
        (producers <= set(schema.SOURCES), f"unknown producers {sorted(producers - set(schema.SOURCES))}"), (declared <= set(schema.CLASSES), f"unknown classes {sorted(declared - set(schema.CLASSES))}"),
        (declared == set(found["classes"]), f"declared and seen classes differ: {sorted(declared ^ set(found['classes']))}"), (set(found["sources"]) <= producers, f"sources not declared: {sorted(set(found['sources']) - producers)}"),
    ]
    broken = [why for ok, why in rules if not ok]
    if broken:
        raise ValueError(f"{folder}: {'; '.join(broken)}")
    return {"meta": meta, "inputs": inputs, "events": events, "folder": folder, "real": real}


def load_corpus(spark: SparkSession, public: str, private: str = "") -> tuple[list[dict], list[str]]:
    """All incidents by folder name, and folders still in progress. An observed incident in the public folder raises, as
    does an id in both."""
    folders = lambda root: sorted(e.path for e in os.scandir(root) if e.is_dir())
    out = [load(spark, d) for d in folders(public)]
    observed = [x["folder"] for x in out if x["real"]]
    if observed:
        raise ValueError(f"observed incidents among the public ones: {', '.join(observed)}")
    pending, seen = [], {x["meta"]["id"] for x in out}
    for folder in folders(private) if private else []:
        if in_progress(folder):
            pending.append(folder)
            continue
        got = load(spark, folder)
        if got["meta"]["id"] in seen:
            raise ValueError(f"id {got['meta']['id']!r} is in both folders")
        out.append(got)
    return out, pending


def real(corpus: list[dict]) -> list[dict]:
    """Observed incidents, the only ones that accuracy may be measured on."""
    return [x for x in corpus if x["real"]]


def next_index(root: str) -> str:
    """The next three-digit prefix of a folder of incidents; a missing folder starts at 001."""
    names = [e.name for e in os.scandir(root) if e.is_dir()] if os.path.isdir(root) else []
    return f"{max([int(m[0]) for n in names if (m := re.match(r'[0-9]{3}', n))], default=0) + 1:03d}"


def inputs(spark: SparkSession, corpus: list[dict]) -> DataFrame:
    """Lines of all inputs, with the incident's id."""
    rows = captures.read_lines(spark, [os.path.join(x["folder"], INPUT) for x in corpus])
    return rows.withColumn("incident", F.regexp_extract("path", r"([^/]+)/input/[^/]+$", 1))
