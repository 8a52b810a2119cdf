"""Queries over texts: scanner, pseudonyms, redaction, readers of captures made from the events table."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.pseudonym import PREFIXES, pads, pseudonym
from ..operators import redact, scan
from ..operators.validate import registered_only
from ..schema import registry
from ..sources import accounting, devices, hosts, logs
from .evidence import EV, events, key_of, spread, table, ts_text

SALT = b"a-salt-for-tests-only"

# ---- scanner ----


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.lines_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pii_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(_lines(spark, sf_dir)).withColumnRenamed("path", "doc_id")


def pii_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_rule(scan.scan(_lines(spark, sf_dir)))


def pii_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings left after every ipv4 match that occurs in a document of even id is suppressed."""
    lines = _lines(spark, sf_dir)
    reviewed = scan.scan(lines.filter("path % 2 = 0")).filter("rule = 'ipv4'").select("rule", "match").distinct()
    return scan.scan(lines, reviewed).withColumnRenamed("path", "doc_id")


def _q(text: str) -> str:
    return text.replace("'", "''")


def _re2(pattern: str) -> str:
    return _q(pattern)


_ALLOW = {
    "ipv4": "len(list_filter(string_split(m, '.'), lambda o: CAST(o AS INT) > 255)) > 0 OR regexp_matches(m, '^(127\\.|0{1,3}\\.|192\\.0{1,3}\\.0{0,2}2\\.|198\\.0?51\\.100\\.|203\\.0{1,3}\\.113\\.)')",
    "ib-guid": "starts_with(lower(m), '0x000000000000')",
    "fqdn": " OR ".join(f"suffix(lower(m), '{d}')" for d in scan.RESERVED_DOMAINS),
    "home-path": f"regexp_matches(regexp_replace(m, '^.*/', ''), '{scan.PSEUDONYM}')",
    "uid": "coalesce(TRY_CAST(regexp_extract(m, '([0-9]+)', 1) AS HUGEINT) < 1000 OR TRY_CAST(regexp_extract(m, '([0-9]+)', 1) AS HUGEINT) > 60000, TRUE)",
    "slurm-conf-host": f"regexp_matches(regexp_replace(trim(regexp_replace(m, '^[^=]*=', '')), '\\[[^\\]]*\\]', '0000', 'g'), '{scan.PSEUDONYM}')",
}


def _scan_sql() -> str:
    parts = []
    for rule, pattern in scan.RULES.items():
        p = _re2(pattern)
        parts.append(f"SELECT doc_id, line_no, line, '{rule}' AS rule, regexp_extract_all(line, '{p}') AS ms, regexp_split_to_array(line, '{p}') AS gs FROM l WHERE regexp_matches(line, '{p}')")
    allow = "CASE rule " + " ".join(f"WHEN '{r}' THEN ({a})" for r, a in _ALLOW.items()) + " ELSE FALSE END"
    return f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT * FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM t) WHERE NOT contains(line, '{scan.ANNOTATION}')),
h AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, line_no, rule, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM h),
f AS (
  SELECT doc_id, line_no, rule, ms[i] AS m,
    CAST(1 + list_sum(list_transform(gs[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: strlen(g))), 0) AS BIGINT) AS col FROM e
), n AS (SELECT doc_id, line_no, col, rule, m AS match FROM f WHERE NOT {allow})"""


PII_SQL = _scan_sql()

# ---- pseudonyms and redaction ----


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's key: every name with its pseudonym, those that share one too. Nothing is rewritten here; what rewrites a bundle raises on them."""
    s = table(spark, sf_dir, "supplier")
    return redact.mapping(s.select(F.lit("host").alias("kind"), F.col("s_name").alias("original")).distinct(), SALT)


def _hmac_sql(kind: str, value: str) -> str:
    """DuckDB: digest of an HMAC whose message is kind, NUL, value."""
    inner, outer = pads(SALT)
    digest = f"sha256(from_hex('{inner}') || encode('{kind}') || from_hex('00') || encode({value}))"
    return f"sha256(from_hex('{outer}') || from_hex({digest}))"


def _pseudonym_sql(kind: str, value: str) -> str:
    return f"CASE WHEN {value} = '' THEN '' ELSE concat('{PREFIXES[kind]}', lpad(CAST(CAST(concat('0x', substr({_hmac_sql(kind, value)}, 1, 8)) AS BIGINT) % 100000000 AS STRING), 8, '0')) END"


def reference_pseudonym(kind: str, value: str, salt: bytes = SALT) -> str:
    """Plain Python, for the tests."""
    digest = hmac.new(salt, kind.encode() + b"\0" + value.encode(), hashlib.sha256).digest()
    return f"{PREFIXES[kind]}{int.from_bytes(digest[:4], 'big') % 100000000:08d}" if value else ""


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with account names of home paths and addresses rewritten: digest and how long they became."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = redact.structural(F.col("text"), SALT)
    return d.select("doc_id", F.sha2(out, 256).alias("text_sha256"), F.length(out).cast("long").alias("n_chars"), (out != F.col("text")).alias("changed"))


REDACT_SQL = rf"""
WITH h AS (
  SELECT doc_id, text, regexp_extract_all(text, '(/(?:home|users|u)/)([^/\s:,]+)') AS ms, regexp_split_to_array(text, '(?:/(?:home|users|u)/)(?:[^/\s:,]+)') AS gs FROM documents WHERE text IS NOT NULL
), a AS (
  SELECT doc_id, text, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: concat(gs[i], CASE WHEN i <= len(ms) THEN concat(regexp_extract(ms[i], '^(/(?:home|users|u)/)', 1), {_pseudonym_sql("user", "regexp_replace(ms[i], '^/(?:home|users|u)/', '')")}) ELSE '' END)), '') AS t FROM h
), b AS (SELECT doc_id, text, regexp_extract_all(t, '{scan.RULES["ipv4"]}') AS ms, regexp_split_to_array(t, '{scan.RULES["ipv4"]}') AS gs FROM a),
c AS (
  SELECT doc_id, text, array_to_string(list_transform(range(1, len(gs) + 1), lambda i: concat(gs[i], CASE WHEN i <= len(ms) THEN CASE WHEN len(list_filter(string_split(ms[i], '.'), lambda o: CAST(o AS INT) > 255)) = 0 THEN {_pseudonym_sql("addr", "ms[i]")} ELSE ms[i] END ELSE '' END)), '') AS t FROM b
)
SELECT doc_id, sha256(t) AS text_sha256, length(t) AS n_chars, t <> text AS changed FROM c
UNION ALL SELECT doc_id, NULL, NULL, NULL FROM documents WHERE text IS NULL"""


#: Where a made-up event has its free-form text: an identifying key if its class has one, else one that stays as it is.
FREE = "CASE class WHEN 'app.nonzero_exit' THEN 'command' WHEN 'resource.oom' THEN 'cgroup' ELSE 'signal' END"


def redact_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, with users and a text that names host, user and an address, redacted."""
    e = events(spark, sf_dir)
    user = F.concat(F.lit("u"), (F.col("ordinal") % 40).cast("string"))
    free = F.concat(F.lit("/opt/run/"), F.col("node"), F.lit("/"), user, F.lit(" 10.1.2.3"))
    attrs = F.create_map(F.lit("user"), user, F.expr(FREE), free, F.lit("state"), F.lit("S1"))
    r = redact.redact_events(e.withColumn("detail", F.struct(F.col("detail.signature").alias("signature"), attrs.alias("attrs"))), SALT)
    return r.select(F.col("ordinal").alias("event_id"), "cluster", "node", F.expr(FREE).alias("key"), *[F.try_element_at("detail.attrs", k).alias(n) for n, k in (("user", F.lit("user")), ("free", F.expr(FREE)), ("state", F.lit("state")))])


def _bundle_sql() -> str:
    return f"""
WITH {EV}, e AS (
  SELECT event_id, cluster, node, {FREE} AS key, concat('u', CAST(event_id % 40 AS STRING)) AS usr FROM ev
), p AS (
  SELECT 'host' AS kind, node AS f, {_pseudonym_sql("host", "node")} AS t FROM (SELECT DISTINCT node FROM e WHERE node <> '')
  UNION ALL SELECT 'user', usr, {_pseudonym_sql("user", "usr")} FROM (SELECT DISTINCT usr FROM e)
  UNION ALL SELECT 'cluster', 'cluster-a', {_pseudonym_sql("cluster", "'cluster-a'")}
), w AS (SELECT list({{'f': f, 't': t}} ORDER BY strlen(f) DESC, f, kind) AS ws FROM p),
x AS (SELECT e.*, {_pseudonym_sql("addr", "'10.1.2.3'")} AS addr FROM e)
SELECT event_id, {_pseudonym_sql("cluster", "cluster")} AS cluster, {_pseudonym_sql("host", "node")} AS node, key, {_pseudonym_sql("user", "usr")} AS user,
  CASE WHEN key = 'signal' THEN concat('/opt/run/', node, '/', usr, ' 10.1.2.3')
    ELSE list_reduce(ws, lambda a, p: {{'f': replace(a.f, p.f, p.t), 't': ''}}, {{'f': concat('/opt/run/', node, '/', usr, ' ', addr), 't': ''}}).f END AS free, 'S1' AS state
FROM x, w"""


# ---- readers ----

#: Messages of a made-up log, by event_id modulo their number; the last is of no known kind.
MESSAGES = (
    "concat('Memory cgroup out of memory: Killed process ', CAST(event_id AS STRING), ' (python3) total-vm:41kB, anon-rss:90kB')",
    "'python3 invoked oom-killer: gfp_mask=0xcc0'",
    "concat('memory: usage ', CAST(user_id AS STRING), 'kB, limit 8388608kB, failcnt 1')",
    "concat('error: Detected 1 oom_kill event in StepId=', CAST(user_id AS STRING), '.batch. Some of the step tasks have been OOM Killed.')",
    "concat('error: *** JOB ', CAST(user_id AS STRING), ' ON node-0001 CANCELLED AT 2024-01-01T00:00:00 DUE TO TIME LIMIT ***')",
    "concat('*** STEP ', CAST(user_id AS STRING), '.0 ON node-0001 CANCELLED AT 2024-01-01T00:00:00 DUE TO STEP TIME LIMIT ***')",
    "'Expired credential for client'", "'error: Munge decode failed: Rewound credential'", "'error: Unable to register: Zero Bytes were sent, authentication error'",
    "'error: node-0002 has authentication error: Invalid credential'", "'System clock wrong by -12.75 seconds'", "'time reset 3.5 s'", "'error: Nodes node-[01-04] not responding, setting DOWN'",
    "'error: Nodes node-0005 not responding'", "'mlx5_core 0000:c1:00.0: mlx5_port_module_event:1: Port module event: Cable unplugged'", "'infiniband mlx5_0: ib_event: Port 1 link down'",
    "'infiniband mlx5_0: ib_event: Port 1 link up'", "'NVRM: Xid (PCI:0000:c1:00.0): 79, GPU has fallen off the bus'", "'GPU at PCI:0000:c1:00: GPU has fallen off the bus'",
    "'Lustre: scratch-OST: Stale file handle'", "'nfs: server storage-1 not responding, still trying'", "'session opened for user root'",
)
MESSAGE = f"CASE event_id % {len(MESSAGES)} " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(MESSAGES)) + " END"
STAMP = "replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T')"
LINE = f"CASE WHEN event_id % 31 = 0 THEN concat('garbled ', props) WHEN event_id % 3 = 0 THEN concat('[', {STAMP}, '] ', {MESSAGE}) ELSE concat({STAMP}, '+0200 host-', CAST(user_id AS STRING), ' unit[7]: ', {MESSAGE}) END"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events")).select(F.lit("log").alias("path"), F.col("event_id").alias("line_no"), F.expr(LINE).alias("line"))


def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = logs.events(_log(spark, sf_dir), "cluster-a", host="ctl", zone="UTC")
    return e.select(F.col("ordinal").alias("event_id"), ts_text().alias("ts_text"), "node", F.col("jobid.raw").alias("job_raw"), "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key"))


def log_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.events(_log(spark, sf_dir), "cluster-a", host="ctl")[1]


def _signature_sql() -> str:
    sig = "CASE " + " ".join(f"WHEN regexp_matches(msg, '{_q(s[2])}') THEN {i}" for i, s in enumerate(logs.SIGNATURES)) + " END"
    known = registry()

    def value(spec, pattern: str) -> str:
        if isinstance(spec, int):
            return f"regexp_extract(msg, '{_q(pattern)}', {spec})"
        if isinstance(spec, tuple) and spec[0] == "kb":
            return f"CAST(CAST(regexp_extract(msg, '{_q(pattern)}', {spec[1]}) AS BIGINT) * 1024 AS STRING)"
        if isinstance(spec, tuple):
            return f"string_split(regexp_extract(msg, '{_q(pattern)}', {spec[1]}), '.')[1]"
        return f"'{spec}'"

    def case(key: str, only: bool) -> str:
        hits = [(i, value(a[key], p)) for i, (_, c, p, a) in enumerate(logs.SIGNATURES) if key in a and (not only or key in known[c])]
        return "CASE sig " + " ".join(f"WHEN {i} THEN {v}" for i, v in hits) + " END" if hits else "NULL"

    keys = sorted({k for s in logs.SIGNATURES for k in s[3] if k not in ("job", "node")} | {"severity"})
    error = "CASE WHEN starts_with(msg, 'error:') OR contains(unit, 'error') THEN 'error' END"
    pairs = [f"CASE WHEN nullif({error if k == 'severity' else case(k, True)}, '') IS NOT NULL THEN concat('\"{k}\":\"', {error if k == 'severity' else case(k, True)}, '\"') END" for k in keys]
    names = "CASE sig " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(logs.SIGNATURES)) + " END"
    classes = "CASE sig " + " ".join(f"WHEN {i} THEN '{s[1]}'" for i, s in enumerate(logs.SIGNATURES)) + " END"
    return f"""
WITH l AS (SELECT event_id, {STAMP} AS stamp, user_id, event_id % 3 = 0 AS daemon, event_id % 31 = 0 AS bad, {MESSAGE} AS msg, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'unit' END AS unit FROM events),
s AS (SELECT *, {sig} AS sig, CAST(replace(stamp, 'T', ' ') AS TIMESTAMP) - CASE WHEN daemon THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END AS ts FROM l WHERE NOT bad)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts_text, coalesce({case("node", False)}, CASE WHEN daemon THEN 'ctl' ELSE concat('host-', CAST(user_id AS STRING)) END) AS node,
  {case("job", False)} AS job_raw, {classes} AS class, {names} AS signature, concat('{{', array_to_string(list_filter([{", ".join(pairs)}], lambda x: x IS NOT NULL), ','), '}}') AS attrs_key
FROM s WHERE sig IS NOT NULL"""


WARN_SQL = f"""
SELECT 'unparsed line' AS kind, count(*) AS n, min(event_id) AS first_line, arg_min({LINE}, event_id) AS example FROM events WHERE event_id % 31 = 0"""

STATES = ("OUT_OF_ME+", "TIMEOUT", "CANCELLED by 1001", "COMPLETED", "NODE_FAIL", "C+", "FAILED", "")
STATE = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END"
NORMAL = "CASE event_id % 8 WHEN 0 THEN 'OUT_OF_MEMORY' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'CANCELLED' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'NODE_FAIL' WHEN 5 THEN 'C+' WHEN 6 THEN 'FAILED' END"
SIZES = "concat(CAST(user_id AS STRING), CASE event_id % 6 WHEN 0 THEN 'K' WHEN 1 THEN 'Mn' WHEN 2 THEN 'Gc' WHEN 3 THEN '.5G' WHEN 4 THEN 'x' ELSE '' END)"
SPANS = "CASE event_id % 6 WHEN 0 THEN concat('00:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':09') WHEN 1 THEN concat('2-0', CAST(event_id % 10 AS STRING), ':00:00') WHEN 2 THEN '1-12:30' WHEN 3 THEN 'UNLIMITED' WHEN 4 THEN '05:09.250' ELSE CAST(user_id AS STRING) END"
SACCT = f"concat(CAST(user_id AS STRING), CASE event_id % 9 WHEN 0 THEN 'x' WHEN 1 THEN '.batch' ELSE '' END, '|job|gpu|acct-01|16|', {STATE}, '|0:125|8G|8190M|', '02:00:00|', '00:11:51|', CASE event_id % 4 WHEN 0 THEN 'node-[01-02]' WHEN 1 THEN 'None assigned' ELSE concat('node-', CAST(user_id AS STRING)) END, '|', {STAMP}, '|', CASE WHEN event_id % 50 = 0 THEN 'Unknown' ELSE {STAMP} END, '|user-01')"


def sacct_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread(table(spark, sf_dir, "events")).select(F.concat(F.lit("sacct-"), (F.col("user_id")).cast("string")).alias("path"), F.col("event_id").alias("line_no"), F.expr(SACCT).alias("line"))
    e, _ = accounting.events(lines, "cluster-a")
    return e.select(F.col("ordinal").alias("event_id"), ts_text().alias("ts_text"), "node", F.col("jobid.raw").alias("job_raw"), "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key"))


def sacct_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table in the fixed form: a header and a rule in each file, then rows cut by the rule's places."""
    e = table(spark, sf_dir, "events")
    path, wide = F.concat(F.lit("sacct-"), F.col("user_id").cast("string")).alias("path"), 22
    cells = F.transform(F.split(F.expr(SACCT), r"\|"), lambda x: F.rpad(x, wide, " "))
    rows = e.select(path, (F.col("event_id") + 10).alias("line_no"), F.array_join(cells, " ").alias("line"))
    head = F.array(F.lit(" ".join(f"{c:<{wide}}" for c in accounting.FIELDS)), F.lit(" ".join("-" * wide for _ in accounting.FIELDS)))
    top = e.select(path).distinct().select("path", F.posexplode(head).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + F.lit(1).cast("long"))
    found, _ = accounting.events(top.unionByName(rows), "cluster-a")
    return found.select((F.col("ordinal") - 10).alias("event_id"), ts_text().alias("ts_text"), "node", F.col("jobid.raw").alias("job_raw"), "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key"))


SACCT_SQL = f"""
WITH s AS (SELECT event_id, ts, user_id, {NORMAL} AS state, {STAMP} AS stamp FROM events WHERE event_id % 9 <> 0 AND event_id % 50 <> 0),
c AS (SELECT *, CASE state WHEN 'OUT_OF_MEMORY' THEN 'resource.oom' WHEN 'TIMEOUT' THEN 'resource.walltime_exceeded' WHEN 'CANCELLED' THEN 'sched.cancelled' WHEN 'NODE_FAIL' THEN 'sched.node_fail' WHEN 'FAILED' THEN 'app.nonzero_exit' ELSE 'unknown' END AS class FROM s WHERE state IS NOT NULL AND state <> 'COMPLETED')
SELECT event_id, concat(stamp, '.000000000Z') AS ts_text, CASE WHEN event_id % 4 >= 2 THEN concat('node-', CAST(user_id AS STRING)) END AS node,
  concat(CAST(user_id AS STRING), CASE WHEN event_id % 9 = 1 THEN '.batch' ELSE '' END) AS job_raw, class, concat('slurm.sacct.state.', state) AS signature,
  concat('{{"account":"acct-01",', CASE WHEN class = 'resource.walltime_exceeded' THEN '"elapsed_seconds":"711",' ELSE '' END, '"exit_code":"0:125",',
    CASE class WHEN 'resource.oom' THEN '"limit_bytes":"8589934592",' WHEN 'resource.walltime_exceeded' THEN '"limit_seconds":"7200",' ELSE '' END,
    '"partition":"gpu","state":"', state, '",', CASE WHEN class = 'resource.oom' THEN '"usage_bytes":"8587837440",' ELSE '' END, '"user":"user-01"}}') AS attrs_key
FROM c"""


def _scalar(expr: str, made, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").select("event_id", F.expr(expr).alias("text")).select("event_id", made(F.col("text")).alias("out"))

    query.__name__ = name
    return query


BYTES_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id * 1024 AS STRING) WHEN 1 THEN CAST(user_id * 1048576 AS STRING) WHEN 2 THEN CAST(user_id * 1073741824 AS STRING)
  WHEN 3 THEN CAST(user_id * 1073741824 + 536870912 AS STRING) WHEN 4 THEN NULL ELSE CAST(user_id AS STRING) END AS out FROM events"""
SECONDS_SQL = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST((event_id % 60) * 60 + 9 AS STRING) WHEN 1 THEN CAST(2 * 86400 + (event_id % 10) * 3600 AS STRING) WHEN 2 THEN CAST(86400 + 12 * 60 + 30 AS STRING)
  WHEN 3 THEN NULL WHEN 4 THEN '309' ELSE CAST(user_id AS STRING) END AS out FROM events"""

DRIVER = "concat(CAST(520 + event_id % 50 AS STRING), '.', CAST(user_id % 99 AS STRING), '.', lpad(CAST(event_id % 20 AS STRING), 2, '0'))"
CUDA = "concat('12.', CAST(user_id % 8 AS STRING))"


def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers under the least one of their runtime; an unlisted runtime claims nothing."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(DRIVER).alias("driver"), F.expr(CUDA).alias("cuda"))
    return e.filter(S.driver_too_old(F.col("driver"), F.col("cuda"))).withColumn("expected", S.lookup(S.MIN_DRIVER, F.col("cuda")))


VERSION_SQL = f"""
WITH m(cuda, expected) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in S.MIN_DRIVER.items())}), e AS (SELECT event_id, {DRIVER} AS driver, {CUDA} AS cuda FROM events)
SELECT event_id, driver, e.cuda, expected FROM e JOIN m ON m.cuda = e.cuda
WHERE [CAST(x AS INT) FOR x IN string_split(driver, '.')] < [CAST(x AS INT) FOR x IN string_split(expected, '.')]"""

CMDLINE = "concat('BOOT_IMAGE=/vmlinuz-5.14 root=UUID=', CAST(event_id AS STRING), ' ro  rd.lvm.lv=a/b ', CASE event_id % 3 WHEN 0 THEN 'isolcpus=2 hugepages=8' WHEN 1 THEN 'hugepages=8 isolcpus=2 resume=/dev/sda' ELSE 'mitigations=off rw quiet' END)"
CMDLINE_SQL = """
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'BOOT_IMAGE=/vmlinuz-5.14 hugepages=8 isolcpus=2' ELSE 'BOOT_IMAGE=/vmlinuz-5.14 mitigations=off quiet' END AS out FROM events"""
MOUNT = r"concat('/mnt\\040data\\011', CAST(event_id % 5 AS STRING), '\\134040')"
TIMES = f"CASE event_id % 5 WHEN 0 THEN concat({STAMP}, '+02:00') WHEN 1 THEN concat({STAMP}, '.5-0430') WHEN 2 THEN concat({STAMP}, 'Z') WHEN 3 THEN {STAMP} ELSE 'yesterday' END"
TIMES_SQL = f"""
WITH t AS (SELECT event_id, CAST(replace({STAMP}, 'T', ' ') AS TIMESTAMP) AS t FROM events)
SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN t - INTERVAL 2 HOUR WHEN 1 THEN t + INTERVAL 270 MINUTE + INTERVAL 500 MILLISECOND WHEN 2 THEN t WHEN 3 THEN t - INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS out FROM t"""


def mount_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("/mnt\\040data\\011"), (F.col("event_id") % 5).cast("string"), F.lit("\\134"))
    return e.select("event_id", S.unescape_mount(text).alias("out"))


def typed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in the five forms that are typed, in the canonical one."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS'Z'", None, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    ahead = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(2)), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    typed = F.coalesce(*[F.when(F.col("event_id") % 5 == i, F.date_format("ts", f) if f else ahead) for i, f in enumerate(forms)])
    return e.select("event_id", S.canonical_time(typed).alias("out"))


TYPED_SQL = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' WHEN 4 THEN strftime(ts, '%Y-%m-%dT00:00:00.000000000Z')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.000000000Z') END AS out FROM events"""

#: Files captured on the host of a supplier.
CAPTURED = {
    "os-release": "concat('ID=\"n', s_nationkey, '\"')", "environ.txt": "'MODULEPATH=/b:/a:/b'", "scontrol.txt": "concat('slurm 23.02.', s_suppkey % 7)",
    "slurm.conf": "concat('clustername = c', s_nationkey, ' # by hand')", "mounts": "concat('s:/x /scratch', s_suppkey % 3, ' lustre rw')",
}


def host_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What discovery makes of the captured files of every host."""
    held = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(x).alias("line")) for n, x in CAPTURED.items()])
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("host"), F.inline(held)).withColumn("line_no", F.lit(1).cast("long"))
    return hosts.discover(lines)


FACTS_SQL = """SELECT CAST(s_suppkey AS STRING) AS host,
  unnest(['cluster', 'scheduler.kind', 'scheduler.version', 'scheduler.config_path', 'modules.kind', 'modules.roots', 'os.id', 'mounts', 'bmc.kind']) AS key,
  unnest([concat('c', s_nationkey), 'slurm', concat('23.02.', s_suppkey % 7), '/etc/slurm/slurm.conf', 'none', '/a,/b', concat('n', s_nationkey), concat('/scratch', s_suppkey % 3, '(lustre)'), 'none']) AS value FROM supplier"""


# ---- devices ----

STDERR = """CASE WHEN event_type = 'signup' THEN concat('n:1:2 [2] NCCL INFO comm 0x5 rank ', CAST(event_id % 3 AS STRING), ' nranks ', CAST(8 + event_id % 9 AS STRING), ' busId 47 commId 0x', CAST(event_id AS STRING), ' - Init')
  WHEN event_type = 'error' THEN concat('[rank', CAST(event_id % 3 AS STRING), ']: Watchdog caught collective operation timeout: WorkNCCL(SeqNum=1, OpType=ALLREDUCE, NumelIn=2, Timeout(ms)=', CAST(1000 + user_id * 7 AS STRING), ') ran')
  WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN concat('module load cuda/12.', CAST(event_id % 5 AS STRING))
  WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'RuntimeError: CUDA driver version is insufficient for CUDA runtime version' ELSE 'step 1' END"""


def nccl_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lines = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), F.expr(STDERR).alias("line"))
    none = F.lit(None).cast("struct<raw:string>")
    jobs = e.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("ts").cast("timestamp").alias("at")).withColumns({"jobid": none, "node": F.lit("node-0001")})
    found = devices.stderr_events(lines, jobs, "cluster-a")
    return found.select(F.col("ordinal").alias("event_id"), ts_text().alias("ts_text"), "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key"))


NCCL_SQL = """
WITH l AS (SELECT event_id, user_id, event_type, CAST(event_id % 3 AS STRING) AS rk, max(ts) OVER (PARTITION BY user_id) AS t0 FROM events),
t AS (
  SELECT a.event_id, a.t0, a.rk, a.user_id, max(i.event_id) AS init FROM l a LEFT JOIN l i ON i.user_id = a.user_id AND i.event_type = 'signup' AND i.rk = a.rk AND i.event_id < a.event_id
  WHERE a.event_type = 'error' GROUP BY a.event_id, a.t0, a.rk, a.user_id
), c AS (
  SELECT a.event_id, a.t0, min(m.event_id) AS m0 FROM l a LEFT JOIN l m ON m.user_id = a.user_id AND m.event_type = 'purchase' AND m.event_id % 7 = 0 AND m.event_id <= a.event_id
  WHERE a.event_type = 'view' AND a.event_id % 5 = 0 GROUP BY a.event_id, a.t0
)
SELECT event_id, strftime(t0, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS ts_text, 'fabric.nccl_timeout' AS class, 'nccl.watchdog.collective_timeout' AS signature,
  concat('{', CASE WHEN init IS NULL THEN '' ELSE concat('"comm":"0x', CAST(init AS STRING), '",') END, '"op":"ALLREDUCE","rank":"', rk, '","timeout_seconds":"', CAST((1000 + user_id * 7) // 1000 AS STRING), '"',
    CASE WHEN init IS NULL THEN '' ELSE concat(',"world_size":"', CAST(8 + init % 9 AS STRING), '"') END, '}') AS attrs_key FROM t
UNION ALL
SELECT event_id, strftime(t0, '%Y-%m-%dT%H:%M:%S.%f') || '000Z', 'gpu.driver_mismatch', 'cuda.runtime.driver_insufficient', CASE WHEN m0 IS NULL THEN '{}' ELSE concat('{"cuda_version":"12.', CAST(m0 % 5 AS STRING), '"}') END FROM c"""

#: A GPU snapshot per user: time, versions, then device and use lines in turn.
SMI = """CASE WHEN nr = 1 THEN 'Wed Mar  6 10:51:40 2024' WHEN nr = 2 THEN concat('| NVIDIA-SMI 5            Driver Version: ', CAST(530 + user_id % 30 AS STRING), '.54.15   CUDA Version: 12.', CAST(user_id % 8 AS STRING), '      |')
  WHEN nr % 2 = 1 THEN concat('|   ', CAST((nr - 3) / 2 AS INT), '  NVIDIA H100 80GB HBM3          On  | 00000000:47:00.0 Off |                    0 |')
  ELSE concat('| N/A   41C    P0             112W / 700W |  ', CAST(event_id % 900 * 100 AS STRING), 'MiB / 81559MiB |      ', CAST(event_id % 2 AS STRING), '%      Default |') END"""


def gpu_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nr = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", nr.alias("nr"))
    lines = e.select(F.col("user_id").cast("string").alias("path"), F.col("nr").cast("long").alias("line_no"), F.expr(SMI).alias("line"))
    found = devices.gpu_events(lines, "cluster-a", "node-0001")
    return found.groupBy(ts_text().alias("ts_text"), "class", F.col("detail.signature").alias("signature"), key_of().alias("attrs_key")).agg(F.count("*").alias("n"))


GPU_SQL = f"""
WITH m(cuda, expected) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in S.MIN_DRIVER.items())}), e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events),
f AS (SELECT user_id, concat(CAST(530 + user_id % 30 AS STRING), '.54.15') AS driver, concat('12.', CAST(user_id % 8 AS STRING)) AS cuda FROM e GROUP BY user_id HAVING count(*) >= 2),
x AS (
  SELECT 'gpu.driver_mismatch' AS class, 'nvidia.driver.runtime_version_mismatch' AS signature, concat('{{"cuda_version":"', f.cuda, '","driver_version":"', driver, '","expected_driver_version":"', expected, '","gpu_index":"0"}}') AS attrs_key
  FROM f JOIN m ON m.cuda = f.cuda WHERE [CAST(x AS INT) FOR x IN string_split(driver, '.')] < [CAST(x AS INT) FOR x IN string_split(expected, '.')]
  UNION ALL SELECT 'unknown', 'nvidia.smi.allocated_but_idle', '{{"severity":"warn"}}' FROM e WHERE nr >= 4 AND nr % 2 = 0 AND event_id % 2 = 0 AND (event_id % 900 * 100) * 100 // 81559 >= 50
)
SELECT '2024-03-06T10:51:40.000000000Z' AS ts_text, class, signature, attrs_key, count(*) AS n FROM x GROUP BY class, signature, attrs_key"""

IBSTAT = """CASE nr % 7 WHEN 1 THEN concat('CA ''mlx5_', CAST(event_id AS STRING), '''') WHEN 2 THEN concat(chr(9), 'Port ', CAST(user_id % 2 + 1 AS STRING), ':') WHEN 3 THEN concat(chr(9), chr(9), 'State: ', CASE WHEN event_id % 4 = 0 THEN 'Down' ELSE 'Active' END)
  WHEN 4 THEN concat(chr(9), chr(9), 'Physical state: LinkUp') WHEN 5 THEN concat(chr(9), chr(9), 'Rate: ', CAST(100 * (event_id % 3) AS STRING)) WHEN 6 THEN 'Base lid: 0' ELSE concat(chr(9), chr(9), 'Link layer: InfiniBand') END"""


def ibstat_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    nr = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", nr.alias("nr"))
    lines = e.select(F.col("user_id").cast("string").alias("path"), F.col("nr").cast("long").alias("line_no"), F.expr(IBSTAT).alias("line"))
    return devices.ports(lines).select("path", "id", "state", "rate", "link_layer", "healthy", "summary")


IBSTAT_SQL = """
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events), p AS (SELECT *, (nr - 1) // 7 AS blk FROM e),
b AS (
  SELECT user_id, blk, max(event_id) FILTER (WHERE nr % 7 = 1) AS ca, max(event_id) FILTER (WHERE nr % 7 = 3) AS st, count(*) FILTER (WHERE nr % 7 = 4) AS ph, max(event_id) FILTER (WHERE nr % 7 = 5) AS ra, count(*) FILTER (WHERE nr % 7 = 0) AS ll
  FROM p GROUP BY user_id, blk HAVING count(*) FILTER (WHERE nr % 7 = 2) > 0
), v AS (
  SELECT user_id, ca, CASE WHEN st IS NULL THEN '' WHEN st % 4 = 0 THEN 'Down' ELSE 'Active' END AS state, CASE WHEN ph > 0 THEN 'LinkUp' ELSE '' END AS phys, CASE WHEN ra IS NULL THEN '' ELSE CAST(100 * (ra % 3) AS STRING) END AS rate, CASE WHEN ll > 0 THEN 'InfiniBand' ELSE '' END AS link_layer FROM b
)
SELECT CAST(user_id AS STRING) AS path, concat('mlx5_', CAST(ca AS STRING), ':', CAST(user_id % 2 + 1 AS STRING)) AS id, state, rate, link_layer, state = 'Active' AS healthy,
  concat(trim(concat(state, ' ', phys)), CASE WHEN rate = '' THEN '' ELSE concat(' ', rate) END) AS summary FROM v"""


def registered_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attrs of events with one key no class may carry: only registered ones are left."""
    e = events(spark, sf_dir)
    more = F.map_concat("detail.attrs", F.create_map(F.lit("errno"), F.lit("E"), F.lit("xid"), F.lit("79"), F.lit("port"), F.lit("1")))
    return e.select(F.col("ordinal").alias("event_id"), S.attrs_key(registered_only(F.col("class"), more)).alias("attrs_key"))


REGISTERED_SQL = f"""WITH {EV} SELECT event_id, CASE WHEN class = 'fabric.link_flap' THEN replace(attrs_key, '{{"severity"', '{{"port":"1","severity"') ELSE attrs_key END AS attrs_key FROM ev"""

state_normalize = _scalar(STATE, S.normalize_state, "state_normalize")
bytes_of = _scalar(SIZES, S.bytes_of, "bytes_of")
seconds_of = _scalar(SPANS, S.seconds_of, "seconds_of")
cmdline_normalize = _scalar(CMDLINE, S.normalize_cmdline, "cmdline_normalize")
log_time = _scalar(TIMES, lambda c: S.format_time(S.log_time(c, "Europe/Berlin")), "log_time")

QUERIES = {f.__name__: f for f in (
    pii_findings, pii_by_rule, pii_suppressed, pseudonyms, redact_text, redact_bundle, signature_match, log_warnings, sacct_parse, sacct_fixed, typed_times, host_facts, state_normalize, bytes_of, seconds_of, version_compare,
    cmdline_normalize, mount_unescape, log_time, nccl_asof, gpu_idle, ibstat_carry, registered_attrs,
)}
SQL = {
    "pii_findings": PII_SQL + " SELECT * FROM n",
    "pii_by_rule": PII_SQL + " SELECT rule, count(*) AS hits, count(DISTINCT match) AS matches, array_to_string(list_sort(list(DISTINCT match))[1:3], '|') AS examples FROM n GROUP BY rule",
    "pii_suppressed": PII_SQL + " SELECT * FROM n WHERE NOT (rule = 'ipv4' AND match IN (SELECT match FROM n WHERE rule = 'ipv4' AND doc_id % 2 = 0))",
    "pseudonyms": f"SELECT DISTINCT 'host' AS kind, s_name AS original, {_pseudonym_sql('host', 's_name')} AS pseudonym FROM supplier",
    "redact_text": REDACT_SQL,
    "redact_bundle": _bundle_sql(),
    "signature_match": _signature_sql(),
    "log_warnings": WARN_SQL,
    "sacct_parse": SACCT_SQL,
    "sacct_fixed": SACCT_SQL,
    "typed_times": TYPED_SQL,
    "host_facts": FACTS_SQL,
    "state_normalize": f"SELECT event_id, {NORMAL} AS out FROM events",
    "bytes_of": BYTES_SQL,
    "seconds_of": SECONDS_SQL,
    "version_compare": VERSION_SQL,
    "cmdline_normalize": CMDLINE_SQL,
    "mount_unescape": "SELECT event_id, concat('/mnt data', chr(9), CAST(event_id % 5 AS STRING), '\\') AS out FROM events",
    "log_time": TIMES_SQL,
    "nccl_asof": NCCL_SQL,
    "gpu_idle": GPU_SQL,
    "ibstat_carry": IBSTAT_SQL,
    "registered_attrs": REGISTERED_SQL,
}
