"""Site profiles: one file of configuration for each cluster, decoded strictly and written as it is read."""

from __future__ import annotations

import os

from .. import schema
from . import yamlsub

#: Members of a profile and what they hold; a list of one mapping stands for a list of such mappings.
SHAPE = {
    "version": int, "cluster": str,
    "scheduler": {"kind": str, "version": str, "config_path": str, "partitions": list, "qos": list},
    "modules": {"kind": str, "roots": list},
    "builders": [{"kind": str, "root": str}],
    "os": {"id": str, "version_id": str, "kernel_release": str, "glibc_version": str},
    "fabric": {"kind": str, "hcas": list, "rates": list},
    "gpu": {"vendor": str, "driver_version": str, "cuda_version": str, "models": list, "dcgm": bool},
    "mounts": [{"mountpoint": str, "fstype": str, "source": str}],
    "bmc": {"kind": str, "reachable": bool},
    "metrics": [{"kind": str, "endpoint": str}],
    "gaps": [{"name": str, "level": str, "detail": str}],
}
#: Places searched where no profile is named, in order; below a configuration folder the same again.
PLACES = ("sites", "site.yaml")
UNNAMED = "local"


def _value(kind, value, at: str, wrong: list[str]):
    """The value as its kind; what doesn't fit is told in ``wrong``, all of it at once."""
    if isinstance(kind, dict):
        if not isinstance(value, dict):
            wrong.append(f"{at or 'document'}: expected members")
            return {}
        wrong += [f"{at}{'.' if at else ''}{k}: unknown key" for k in value if k not in kind]
        return {k: _value(sub, value[k], f"{at}.{k}" if at else k, wrong) for k, sub in kind.items() if k in value}
    if value == {}:  # a key without a value
        return [] if kind is list or isinstance(kind, list) else kind()
    if kind is list or isinstance(kind, list):
        if not isinstance(value, list):
            wrong.append(f"{at}: expected a list")
            return []
        each = kind[0] if isinstance(kind, list) else str
        return [_value(each, x, f"{at}[{i}]", wrong) for i, x in enumerate(value)]
    if not isinstance(value, str):
        wrong.append(f"{at}: expected one value")
        return kind()
    if kind is bool:
        if value not in ("true", "false"):
            wrong.append(f"{at}: expected true or false, not {value!r}")
        return value == "true"
    if kind is int and not value.isdigit():
        wrong.append(f"{at}: expected a number, not {value!r}")
        return 0
    return kind(value)


def decode(text: str) -> dict:
    """A profile; every unknown key and every value of the wrong kind is named in one error. A missing version is the
    current one, a missing cluster or another version an error."""
    wrong: list[str] = []
    out = _value(SHAPE, yamlsub.parse(text), "", wrong)
    if wrong:
        raise ValueError("\n".join(wrong))
    if not out.get("cluster"):
        raise ValueError("cluster: required")
    if out.setdefault("version", schema.PROFILE_VERSION) != schema.PROFILE_VERSION:
        raise ValueError(f"version: {out['version']}, only {schema.PROFILE_VERSION} is understood")
    return out


def encode(profile: dict) -> str:
    """Text that decode reads back: members in fixed order, empty ones left out, gaps last."""
    if not profile.get("cluster"):
        raise ValueError("a profile needs a cluster")
    full = {"version": schema.PROFILE_VERSION} | {k: v for k, v in profile.items() if v}

    def kept(kind, value):
        if isinstance(kind, dict):
            return {k: got for k, sub in kind.items() if k in value and (got := kept(sub, value[k])) not in ("", None, [], {})}
        return [kept(kind[0], x) for x in value] if isinstance(kind, list) else value

    head = "# What kind of cluster this is. Correct by hand what is wrong; gaps lists what was looked for and not found.\n"
    return head + yamlsub.render(kept(SHAPE, full))


def from_facts(facts: dict[str, str], gaps: list[dict] = ()) -> dict:
    """The profile of one host's discovered facts (key -> value, see hosts.discover) and unavailable probes."""
    out: dict = {"version": schema.PROFILE_VERSION, "cluster": facts.get("cluster", "")}
    for section, members in SHAPE.items():
        if isinstance(members, dict):
            read = {k: facts[f"{section}.{k}"] for k in members if facts.get(f"{section}.{k}")}
            out[section] = {k: v.split(",") if members[k] is list else v == "true" if members[k] is bool else v for k, v in read.items()}
    listed = lambda key: [x for x in facts.get(key, "").split(",") if x]
    out["builders"] = [dict(zip(("kind", "root"), x.split("=", 1), strict=False)) for x in listed("builders")]
    out["mounts"] = [{"mountpoint": x.rpartition("(")[0], "fstype": x.rpartition("(")[2].rstrip(")")} for x in listed("mounts")]
    out["metrics"] = [{"kind": x} for x in listed("metrics")]
    out["gaps"] = [{k: g.get(k) or "" for k in ("name", "level", "detail")} for g in gaps]
    return {k: v for k, v in out.items() if v}


def load(path: str) -> dict[str, tuple[dict, str]]:
    """cluster -> (profile, file) of one file or of all *.yaml in a folder; two files of one cluster raise, as does none."""
    names = sorted(n for n in os.listdir(path) if n.endswith(".yaml") and os.path.isfile(os.path.join(path, n))) if os.path.isdir(path) else None
    files = [path] if names is None else [os.path.join(path, n) for n in names]
    out: dict[str, tuple[dict, str]] = {}
    for file in files:
        with open(file, encoding="utf-8") as f:
            text = f.read()
        try:
            profile = decode(text)
        except ValueError as e:
            raise ValueError(f"{file}: {e}") from e
        if profile["cluster"] in out:
            raise ValueError(f"cluster {profile['cluster']!r} is in {out[profile['cluster']][1]} and in {file}")
        out[profile["cluster"]] = (profile, file)
    if not out:
        raise ValueError(f"no profiles in {path}")
    return out


def discovered(folder: str = ".", config: str = "") -> tuple[dict[str, tuple[dict, str]], str]:
    """The first set of profiles in the usual places, and its path; nothing found is no error."""
    for place in [os.path.join(d, p) for d in (folder, config) if d for p in PLACES]:
        if os.path.exists(place):
            return load(place), place
    return {}, ""


def profile_for(profiles: dict[str, tuple[dict, str]], name: str = "") -> dict:
    """The profile of a cluster, or the only one of a set; {} for an empty set. Any other choice is an error, not a guess."""
    if not profiles:
        return {}
    if name:
        if name not in profiles:
            raise ValueError(f"no profile of cluster {name!r}; there are {', '.join(sorted(profiles))}")
        return profiles[name][0]
    if len(profiles) > 1:
        raise ValueError(f"{len(profiles)} clusters ({', '.join(sorted(profiles))}); name one")
    return next(iter(profiles.values()))[0]


def cluster_name(named: str = "", profile: dict | None = None, configured: str = "") -> str:
    """What events are stamped with: the name given, else the profile's, else the configured one; never a host's name."""
    return named or (profile or {}).get("cluster") or configured or UNNAMED
