"""Default-deny gate over requested actions, as one ordered CASE, and its audit log."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.scalars import matches_any

#: Kinds of action that ship: none. A kind maps to how it is undone.
SHIPPED_ACTIONS: dict[str, str] = {}
GATES = ("unknown_action", "irreversible", "wrong_cluster", "not_allowed", "out_of_scope")


@dataclass
class Policy:
    """Empty lists permit nothing; dry run unless a policy says otherwise."""

    cluster: str = ""
    allow: list[str] = field(default_factory=list)
    nodes: list[str] = field(default_factory=list)
    jobs: list[str] = field(default_factory=list)
    dry_run: bool = True
    version: int = S.POLICY_VERSION

    @classmethod
    def load(cls, path: str) -> Policy:
        """A missing file is deny-all, a missing version the current one; an unknown member or version raises."""
        from ..sources.yamlsub import parse

        if not os.path.exists(path):
            return cls()
        with open(path, encoding="utf-8") as f:
            doc = parse(f.read())
        odd = set(doc) - {"version", "cluster", "allow", "nodes", "jobs", "dry_run"}
        if odd:
            raise ValueError(f"{path}: unknown keys {', '.join(sorted(odd))}")
        if str(doc.get("version", S.POLICY_VERSION)) != str(S.POLICY_VERSION):
            raise ValueError(f"{path}: version {doc.get('version')!r}")
        lists = {k: list(doc.get(k) or []) for k in ("allow", "nodes", "jobs")}
        return cls(cluster=doc.get("cluster", ""), dry_run=doc.get("dry_run", "true") != "false", **lists)


    @classmethod
    def read(cls, path: str) -> tuple[Policy, str]:
        """The policy and no error, or deny-all and the error: never a policy that was half understood."""
        try:
            return cls.load(path), ""
        except (ValueError, AttributeError, TypeError) as e:
            return cls(), str(e)

    def encode(self) -> str:
        """The policy as YAML that ``load`` reads back; members in fixed order."""
        out = [f"version: {self.version}", f'cluster: "{self.cluster}"']
        for name in ("allow", "nodes", "jobs"):
            items = getattr(self, name)
            out += [f"{name}:", *[f'  - "{x}"' for x in items]] if items else [f"{name}: []"]
        return "\n".join([*out, f"dry_run: {str(self.dry_run).lower()}", ""])


def evaluate(requests: DataFrame, policy: Policy, cluster: str = "", actions: dict[str, str] = SHIPPED_ACTIONS) -> DataFrame:
    """requests (kind, node, job) with allowed, gate (the first that fails) and dry_run."""
    kind, none = F.col("kind"), F.lit("")
    node, job = F.coalesce("node", none), F.coalesce("job", none)
    reversible = [k for k, undo in actions.items() if undo]
    foreign = bool(policy.cluster and cluster and policy.cluster != cluster)
    inside = ((node != "") | (job != "")) & ((node == "") | matches_any(node, policy.nodes)) & ((job == "") | matches_any(job, policy.jobs))
    gate = (
        F.when(~F.coalesce(kind.isin(*actions), F.lit(False)) if actions else F.lit(True), GATES[0])
        .when(~kind.isin(*reversible) if reversible else F.lit(True), GATES[1])
        .when(F.lit(foreign), GATES[2])
        .when(~kind.isin(*policy.allow) if policy.allow else F.lit(True), GATES[3])
        .when(~inside, GATES[4])
    )
    return requests.withColumn("gate", gate).withColumn("allowed", F.col("gate").isNull()).withColumn("dry_run", F.lit(policy.dry_run))


class AuditLog:
    """Append-only JSON lines on the driver, flushed to disk before anything acts."""

    def __init__(self, path: str):
        self.path = path

    def record(self, decision: dict) -> None:
        fd = os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600)
        try:
            os.write(fd, (json.dumps(decision, sort_keys=True) + "\n").encode())
            os.fsync(fd)
        finally:
            os.close(fd)

    def last(self, n: int) -> tuple[list[dict], list[int]]:
        """The last n decisions and the numbers of lines that can't be read."""
        with open(self.path, encoding="utf-8") as f:
            rows = list(enumerate(f, 1))[-n:]
        good, bad = [], []
        for at, line in rows:
            try:
                good.append(json.loads(line))
            except ValueError:
                bad.append(at)
        return good, bad


def execute(decisions: list[dict], record: Callable[[dict], None], actions: dict[str, Callable] | None = None) -> list[dict]:
    """Records each decision first; one that can't be recorded is denied, a dry run stops there."""
    out = []
    for d in decisions:
        d = dict(d, executed=False)
        try:
            record(d)
        except OSError as e:
            out.append(dict(d, allowed=False, gate="audit_failed", explain=str(e)))
            continue
        if d["allowed"] and not d["dry_run"] and actions and d["kind"] in actions:
            actions[d["kind"]](d)
            d["executed"] = True
        out.append(d)
    return out
