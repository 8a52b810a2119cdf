"""Scanner for identifying material: rules over lines, with byte columns, suppressions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANNOTATION = "redaction-ok"
SUPPRESSION_FILE = ".redaction-ok"

# The rules' patterns, in RE2 syntax.
RULES = {
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ipv6": r"\b(?:[0-9a-fA-F]{1,4}:){4,}[0-9a-fA-F]{1,4}\b",
    "ib-guid": r"\b0x[0-9a-fA-F]{16}\b",
    "mac": r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "fqdn": r"\b[a-zA-Z0-9][a-zA-Z0-9-]{0,62}(?:\.[a-zA-Z0-9][a-zA-Z0-9-]{0,62})*\.(?:edu|gov|mil|org|com|net|int|ac\.[a-z]{2}|edu\.[a-z]{2}|gov\.[a-z]{2}|de|fr|ch|it|es|nl|se|no|dk|fi|pl|cz|jp|cn|kr|in|au|ca|uk|br|za|sg|il|ru)\b",
    "home-path": r"/(?:home|users|u|nfs/home|gpfs/home)/[A-Za-z0-9._-]+",
    "ssh-key": r"\b(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp\d+)\s+[A-Za-z0-9+/]{20,}",
    "private-key": r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----",
    "long-hex": r"\b[0-9a-fA-F]{32,}\b",
    "uid": r"(?i)\b(?:uid|gid)\s*[=:]\s*(\d+)\b",
    "account-code": r"\b(?:TG-[A-Z]{3}\d{6}|[A-Z]{2,}[-_]?\d{4,})\b",
    "slurm-conf-host": r"(?i)\b(?:ClusterName|ControlMachine|SlurmctldHost|BackupController|AccountingStorageHost|DbdHost|NodeName|NodeHostname|NodeAddr)\s*=\s*([A-Za-z0-9._\[\]{}-]+)",
}
#: A cheap pattern that every match of the rule holds: most lines hold none and go no further.
NEEDS = {
    "ipv4": r"\d\.\d", "ipv6": r"[0-9a-fA-F]:[0-9a-fA-F]", "ib-guid": r"0x[0-9a-fA-F]{16}", "mac": r"[0-9a-fA-F][:-][0-9a-fA-F]{2}[:-]", "email": r"@", "fqdn": r"[a-zA-Z0-9-]\.[a-z]",
    "home-path": r"/(?:home|users|u|nfs|gpfs)/", "ssh-key": r"ssh-|ecdsa-", "private-key": r"-----BEGIN", "long-hex": r"[0-9a-fA-F]{32}", "uid": r"[uUgG][iI][dD]\s*[=:]", "account-code": r"[A-Z][-_]?\d{4}|TG-",
    "slurm-conf-host": r"[a-zA-Z]\s*=",
}
# Shapes of pseudonyms.
PSEUDONYM = r"^(?:node-[0-9]{2,12}|user-[0-9]{2,12}|acct-[0-9]{2,12}|cluster-(?:[a-z]|[0-9]{2,12}))$"
RESERVED_DOMAINS = ("example.com", "example.org", "example.net", ".invalid")

#: RE2's word boundary is over ASCII; Java's may not be.
_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def java(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY).replace(r"\s", r"[\t\n\f\r ]")


def is_pseudonym(text: Column) -> Column:
    return text.rlike(PSEUDONYM)


def allowed(rule: str, m: Column) -> Column:
    """Whether a match of the rule is fine."""
    if rule == "ipv4":
        octets = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
        at = lambda *v: F.slice(octets, 1, len(v)) == F.array(*map(F.lit, v))
        return F.exists(octets, lambda o: o > 255) | at(127) | at(0) | at(192, 0, 2) | at(198, 51, 100) | at(203, 0, 113)
    if rule == "ib-guid":
        return F.lower(m).startswith("0x000000000000")
    if rule == "fqdn":
        out = F.lit(False)
        for end in RESERVED_DOMAINS:
            out = out | F.lower(m).endswith(end)
        return out
    if rule == "home-path":
        return is_pseudonym(F.substring_index(m, "/", -1))
    if rule == "uid":
        n = F.regexp_extract(m, r"(\d+)", 1).try_cast("decimal(38,0)")
        return F.coalesce((n < 1000) | (n > 60000), F.lit(True))
    if rule == "slurm-conf-host":
        value = F.trim(F.regexp_replace(m, r"^[^=]*=", ""))
        return is_pseudonym(F.regexp_replace(value, r"\[[^\]]*\]", "0000"))
    return F.lit(False)


def _matches(rule: str, line: Column) -> Column:
    """Array of (rule, col, match); a match's column is the bytes of what stands before it, and 1."""
    pattern = java(RULES[rule])
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    gaps = F.split(line, pattern, -1)
    sizes = F.zip_with(gaps, found, lambda g, m: F.coalesce(F.octet_length(g), F.lit(0)) + F.coalesce(F.octet_length(m), F.lit(0)))
    before = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    rows = F.transform(found, lambda m, i: F.struct(F.lit(rule).alias("rule"), (before(i) + F.octet_length(F.get(gaps, i)) + 1).cast("long").alias("col"), m.alias("match")))
    return F.when(line.rlike(NEEDS[rule]) & line.rlike(pattern), F.filter(rows, lambda r: ~allowed(rule, r["match"])))


def lines_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, line_no from 1, line of each text."""
    return docs.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def scan(lines: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """path, line_no, col, rule, match of every finding; annotated lines and suppressed (rule, match) are left out."""
    plain = lines.filter(F.col("line").rlike("|".join(f"(?:{n})" for n in NEEDS.values())) & ~F.col("line").contains(ANNOTATION))
    every = F.flatten(F.filter(F.array(*[_matches(r, F.col("line")) for r in RULES]), lambda a: a.isNotNull()))
    found = plain.select("path", "line_no", F.explode(every).alias("f")).select("path", "line_no", "f.col", "f.rule", "f.match")
    return found if suppressions is None else found.join(suppressions, ["rule", "match"], "left_anti").select("path", "line_no", "col", "rule", "match")


def by_rule(findings: DataFrame, examples: int = 3) -> DataFrame:
    """rule, hits, distinct matches and the first few of these, in order."""
    each = findings.groupBy("rule", "match").agg(F.count("*").alias("n"))
    nth = each.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("match")))
    return nth.groupBy("rule").agg(F.sum("n").alias("hits"), F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.col("match")))), "|").alias("examples"))


def parse_suppressions(spark: SparkSession, text: str, path: str = SUPPRESSION_FILE) -> DataFrame:
    """(rule, match, reason) of a reviewed list, one ``RULE MATCH # reason`` a line; errors raise with the line."""
    rows = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        body, mark, reason = line.partition("#")
        if not mark or not reason.strip():
            raise ValueError(f"{path}:{n}: a suppression needs a reason")
        rule, _, match = body.strip().partition(" ")
        if not match.strip():
            raise ValueError(f"{path}:{n}: expected RULE MATCH # reason")
        if rule not in RULES:
            raise ValueError(f"{path}:{n}: unknown rule {rule!r}")
        rows.append((rule, match.strip(), reason.strip()))
    return spark.createDataFrame(rows, "rule string, match string, reason string")


def scannable(paths: DataFrame) -> DataFrame:
    """Files (binaryFile rows) that hold captured output: no source, prose, sidecar, or NUL in the first 8000 bytes."""
    name = F.substring_index("path", "/", -1)
    head = F.substring(F.col("content"), F.lit(1), F.lit(8000))
    return paths.filter(~F.lower(name).rlike(r"\.(go|md)$") & (name != SUPPRESSION_FILE) & (F.instr(F.hex(head), "00").isNull() | ~F.hex(head).rlike("^(..)*00")))
