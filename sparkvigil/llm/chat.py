"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask.

The log has one row per event: ``conv_id, seq, msg_id, op, role, text``. Events of a conversation are
ordered by ``seq`` (nulls last), then by msg_id, op, role and text, so that ties have one result and
repeated rows count as often as they occur. ``op`` is one of

``message``     starts message ``msg_id`` with a role and a text (a repeated one starts it anew),
``delta``       appends streamed text to the message,
``edit``        replaces the message's text,
``regenerate``  drops the message's text and every message that stands after it; later deltas refill it, and later
                events of a dropped message begin it anew, at the end.

Null text is empty, a null role is an empty role, an unknown op is read as ``message``, a null conv_id
is a conversation of its own. A message that never had a ``message`` event takes the role of its first event.
All work is DataFrame expressions. One conversation is one output row, so its events meet in one task;
the conversation is the unit of output and bounded by Spark's 2 GB row.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` per turn. Control strings inside roles and texts
get a backslash after their first character (backslashes are doubled first), so no control string can
appear in escaped text and unescaping, which drops one backslash before any character, is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of common templates; each is broken by a backslash after its first character.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

EVENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("msg_id", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
])


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _one_by_one(events: Column) -> Column:
    """The messages (msg_id, role, text) after each of the sorted events in turn."""

    def step(held: Column, e: Column) -> Column:
        at = F.array_position(F.transform(held, lambda x: x["msg_id"]), e["msg_id"]).cast("int")
        text = F.when(e["op"] == "regenerate", F.lit("")).otherwise(e["text"])
        old = F.get(held, at - 1)
        now = F.struct(
            e["msg_id"].alias("msg_id"), F.when(e["op"].isin("delta", "edit", "regenerate") & (at > 0), old["role"]).otherwise(e["role"]).alias("role"),
            F.when((e["op"] == "delta") & (at > 0), F.concat(old["text"], text)).otherwise(text).alias("text"),
        )
        before = F.slice(held, 1, F.when(at > 0, at - 1).otherwise(F.size(held)))
        after = F.when((at > 0) & (e["op"] != "regenerate"), F.slice(held, at + 1, F.size(held))).otherwise(F.slice(held, 1, 0))
        return F.concat(before, F.array(now), after)

    none = F.array().cast("array<struct<msg_id:bigint,role:string,text:string>>")
    return F.aggregate(events, none, step)


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text), the final messages in order of their first event.

    A regeneration drops what began before it; events of a dropped message that follow begin it anew. Only
    conversations where that happens are folded event by event; elsewhere a message is its last reset and the
    deltas after it.
    """
    log = events.select(
        "conv_id", F.coalesce("msg_id", F.lit(-1)).cast("long").alias("msg_id"), F.coalesce("seq", F.lit(2**63 - 1)).alias("seq"),
        F.coalesce("op", F.lit("message")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # one shuffle: dealt by conversation, which also serves the grouping by message
    dealt = log.repartition("conv_id")
    logs = F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text")))
    messages = dealt.groupBy("conv_id", "msg_id").agg(logs.alias("log"))
    began = F.struct(F.col("log")[0]["seq"].alias("began"), "msg_id", "log")
    found = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(began)).alias("m"))

    def outline(x: Column) -> Column:
        cut = F.array_max(F.transform(F.filter(x["log"], lambda e: e["op"] == "regenerate"), lambda e: e["seq"]))
        return F.struct(x["began"].alias("began"), F.element_at(x["log"], -1)["seq"].alias("ended"), cut.alias("cut"))

    def whole(x: Column) -> Column:
        reset = F.coalesce(F.array_max(F.transform(x["log"], lambda e, i: F.when(e["op"] != "delta", i))), F.lit(0))
        live = F.filter(F.slice(x["log"], reset + 1, F.size(x["log"])), lambda e: e["op"] != "regenerate")
        named = F.filter(x["log"], lambda e: ~e["op"].isin("delta", "edit", "regenerate"))
        role = F.coalesce(F.get(named, F.size(named) - 1)["role"], x["log"][0]["role"])
        return F.struct(role.alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))

    found = found.withColumn("outlines", F.transform("m", outline)).withColumn("cuts", F.filter("outlines", lambda x: x["cut"].isNotNull()))
    dropped = lambda x, c: (c["began"] < x["began"]) & (x["began"] <= c["cut"])
    again = F.exists("cuts", lambda c: F.exists("outlines", lambda x: dropped(x, c) & ((x["ended"] >= c["cut"]) | (x["began"] == c["cut"])) | (x["began"] == c["began"]) & (x["ended"] >= c["cut"]) & (x["cut"].isNull() | (x["cut"] != c["cut"]))))
    ordered = F.array_sort(F.flatten(F.transform("m", lambda x: F.transform(x["log"], lambda e: F.struct(e["seq"].alias("seq"), x["msg_id"].alias("msg_id"), e["op"].alias("op"), e["role"].alias("role"), e["text"].alias("text"))))))
    kept = F.filter("m", lambda x: ~F.exists("cuts", lambda c: dropped(x, c)))
    turns = F.when(F.size("cuts") == 0, F.transform("m", whole)).when(again, F.transform(_one_by_one(ordered), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).otherwise(F.transform(kept, whole))
    return found.select("conv_id", turns.alias("turns"))


def render(conversations: DataFrame, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``segments``, an array of (text, loss) whose texts joined are ``formatted``."""
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*learned_roles).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    out = conversations.withColumn("segments", segments)
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, read back from its text alone."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.split_part(p, F.lit(SEP), F.lit(1))).alias("role"),
        unescape(F.split_part(F.split_part(p, F.lit(SEP), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
    ))


def chat_format(events: DataFrame, learned_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turns, segments (text, loss) and formatted, one row per conversation of the event log."""
    return render(fold(events), learned_roles)


def conversation_log(rows: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log: each row one ``message`` event.

    Rows of equal turn stay separate messages, ordered by role and text; null turns come last.
    """
    order = F.row_number().over(_by_turn())
    return rows.select(F.col("conv_id").cast("long"), order.cast("long").alias("seq"), order.cast("long").alias("msg_id"), F.lit("message").alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :probe), (-1L, 1L, 'assistant', :probe) AS t(conv_id, turn, role, text)", {"probe": PROBE})
    done = chat_format(conversation_log(rows.unionByName(probe))).select("conv_id", "segments", "formatted")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = done.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), learned.alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START) + len(SEP) + len(END)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
