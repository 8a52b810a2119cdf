"""Captured command output and files as lines, and which capture answers which command."""

from __future__ import annotations

import posixpath
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".txt", ".log", ".json", ".xml")
PATH_CHARS = "=,/:"


def command_words(name: str, args: list[str]) -> tuple[str, list[str]]:
    """The command's base name and its bare words; flags and values don't name a capture."""
    return posixpath.basename(name), [a for a in args if not a.startswith("-") and not any(c in a for c in PATH_CHARS)]


def candidates(name: str, args: list[str]) -> list[str]:
    """Names a command's capture may have, the most specific first."""
    base, words = command_words(name, args)
    return ["-".join([base, *words[:n]]) + e for n in range(len(words), -1, -1) for e in EXTENSIONS]


def resolve(files: list[str], name: str, args: list[str]) -> str | None:
    held = set(files)
    return next((c for c in candidates(name, args) if c in held), None)


def resolve_file(files: list[str], path: str) -> str | None:
    """A file's capture goes by the file's base name."""
    base = posixpath.basename(path)
    return base if base in set(files) else None


def present(files: list[str], name: str) -> bool:
    """A tool counts as there if any capture of it is."""
    base = posixpath.basename(name)
    return any(f == base or f.startswith((base + ".", base + "-")) for f in files)


def capture_names(outputs: dict[tuple[str, tuple[str, ...]], bytes]) -> dict[tuple[str, tuple[str, ...]], str]:
    """A name for each recorded command: the least number of words at which different outputs have different names."""
    groups: dict[str, list] = defaultdict(list)
    for (name, args), out in outputs.items():
        base, words = command_words(name, list(args))
        groups[base].append(((name, args), words, out))
    named = {}
    for base, rows in groups.items():
        for depth in range(max(len(w) for _, w, _ in rows) + 1):
            stems: dict[str, set] = defaultdict(set)
            for _, w, out in rows:
                stems["-".join([base, *w[:depth]])].add(out)
            if all(len(v) == 1 for v in stems.values()):
                break
        for key, w, _ in rows:
            named[key] = "-".join([base, *w[:depth]]) + ".txt"
    return named


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, name, producer (name without extension), line_no from 1, line. Files are read whole, so that numbers are
    the file's; for larger logs use read_log."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
    lines = texts.select("path", "name", F.posexplode(F.split(F.regexp_replace("value", r"\n+\z", ""), "\n", -1)).alias("pos", "line"))
    return lines.select("path", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("producer"), (F.col("pos") + 1).cast("long").alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """As read_lines for files of any size, split among tasks; line_no is the order in the file, not the number."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("at"))
    return lines.select("path", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("producer"), (F.col("at") * 4096 + F.monotonically_increasing_id() % (1 << 33)).alias("line_no"), "line")


def modification_times(lines: DataFrame) -> DataFrame:
    """name, mtime of lines ``<name> <RFC 3339 time>``."""
    from ..functions.scalars import offset_time

    return lines.select(F.split("line", r"\s+")[0].alias("name"), offset_time(F.get(F.split("line", r"\s+"), F.lit(1))).alias("mtime")).filter("mtime is not null")


def environment(lines: DataFrame) -> DataFrame:
    """name, value of lines KEY=VALUE."""
    return lines.filter(F.col("line").contains("=")).select(F.substring_index("line", "=", 1).alias("name"), F.regexp_replace("line", "^[^=]*=", "").alias("value"))
