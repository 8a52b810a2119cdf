"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block; white space inside a line becomes one space, character references
are decoded. Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles (by
element, role, or a word of class or id) are left out as if they weren't there, so they part nothing; lines that are
mostly link text have length 0, like the empty lines between nested tags. Text lengths are summed over sliding windows
of ``BLOCK`` lines. A surge is where the sum rises from 0, a dive where it falls back to 0. A stretch between is kept
if its largest sum reaches ``SURGE`` of the page's largest or ``FULL``; so is one between two kept ones that only
markup parts from both. Every line with a length in a kept stretch is kept whole.

``article`` and ``main`` are a boundary only where they hold most of the text: then their edges part stretches, nested
tags inside don't, and what is outside has to reach ``SURGE`` of the largest sum. Elsewhere they are tags like others.

Tags are read in one pass, in time linear in the page. As in browsers, an unclosed comment, script or style, and a tag
without its ``>``, reach to the end of the page; a quote that never closes is a character like others. Comments and
scripts part no words. An unclosed container, and an unclosed iframe, textarea or title, is ignored. Words of class, id
or role mark an element as a whole (``site-header``), unless what stands before says what it goes with
(``content-with-sidebar``); marked elements and forms that hold an unmarked article, and forms that hold most of the
page's text, are wrappers and stay. Null or empty html gives an empty text. Rows are kept one by one, nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 3
SURGE = 0.3
#: BLOCK full lines: a sum that makes a stretch text, however long the page's longest paragraphs are.
FULL = 80 * BLOCK

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens a quoted value.
STOP = re.compile(r">|=\s*[\"']")
NAMED = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements whose content is no markup; the first two reach to the end of the page if they don't close.
RAW = ("script", "style", "iframe", "textarea", "title")
#: Elements and words of class, id or role that mark what isn't the article.
OUT = frozenset("nav header footer aside form menu dialog button select label fieldset noscript template svg".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup "
    "promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Before a marking word: the element is something else, which goes with that word or lacks it.
BESIDE = frozenset("with without has have no and not hide show toggle above below before after".split())
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=1 << 14)
def _marked(name: str, attrs: str) -> bool:
    """Whether a word of class, id or role says that the element isn't the article."""
    if name in ("body", "html") or "=" not in attrs:
        return False
    for m in NAMED.finditer(attrs):
        for token in m[2].lower().split():
            for w in re.split(r"[^a-z]+", token):
                if w in BESIDE:
                    break
                if w in OUT_WORDS:
                    return True
    return False


def tags_of(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the tags, in one pass. Comments and raw content have an empty name."""
    low = page.translate(ASCII_LOWER)
    out: list[tuple[int, int, str, bool, str]] = []
    none: set[str] = set()  # quotes and closing tags that don't come again
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = len(page) if end < 0 else end + 3
            out.append((at, end, "", False, ""))
        elif m := NAME.match(page, at + 1):
            p = m.end()
            while True:
                stop = STOP.search(page, p)
                if stop is None:
                    break
                p = stop.end()
                if page[p - 1] == ">":
                    break
                quote = page[p - 1]
                if quote not in none:
                    close = page.find(quote, p)
                    if close < 0:
                        none.add(quote)
                    else:
                        p = close + 1
            if stop is None:
                out.append((at, len(page), "", False, ""))
                break
            name = m[0].lower()
            end, closing = p, name[0] == "/"
            if closing:
                name = name[1:]
            elif name in RAW and name not in none:
                close = low.find("</" + name, end)
                if close < 0 and name not in RAW[:2]:
                    none.add(name)
                else:
                    close = page.find(">", close) if close >= 0 else -1
                    end = len(page) if close < 0 else close + 1
                    name = ""
            out.append((at, end, name, closing, page[m.end() : p - 1]))
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            out.append((at, end, "", False, ""))
        else:
            end = at + 1
        at = page.find("<", end)
    return out


def _left_out(tags: list[tuple[int, int, str, bool, str]], closes: dict[int, int]) -> set[int]:
    """Opening tags of the containers to leave out."""
    marked = {i for i in closes if tags[i][4] and _marked(tags[i][2], tags[i][4])}
    articles, text, last = [0], [0], 0  # unmarked articles, and characters of text, before each tag
    for i, (start, end, name, closing, _) in enumerate(tags):
        articles.append(articles[-1] + (name in CONTENT and not closing and i not in marked))
        text.append(text[-1] + start - last)
        last = end
    out = set()
    for i, j in closes.items():
        name = tags[i][2]
        if name not in OUT and i not in marked:
            continue
        wraps = name == "form" or name not in OUT
        if wraps and articles[j] > articles[i + 1] or name == "form" and 2 * (text[j + 1] - text[i + 1]) > text[-1]:
            continue
        out.add(i)
    return out


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, length that counts, inside an article) of each line; a container that is left out only ends a line."""
    tags = tags_of(page)
    closes: dict[int, int] = {}  # index of the closing tag
    open_: dict[str, list[int]] = {}
    for i, (_, _, name, closing, attrs) in enumerate(tags):
        if not name or name in VOID or attrs.endswith("/"):
            continue
        if not closing:
            open_.setdefault(name, []).append(i)
        elif open_.get(name):
            closes[open_[name].pop()] = i
    outside = _left_out(tags, closes)
    out: list[tuple[str, int, bool]] = []
    piece: list[str] = []
    linked, inside, anchor = 0, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(piece)).split())
        out.append((text, 0 if linked * 2 > len(text) else len(text), inside > 0))
        piece.clear()
        linked = 0

    at, i = 0, 0
    while i < len(tags):
        start, past, name, closing, _ = tags[i]
        text = page[at:start]
        piece.append(text)
        linked += len(" ".join(text.split())) if anchor else 0
        at = past
        if i in outside:
            if "".join(piece).strip():
                end()
            i = closes[i]
            at = tags[i][1]
        elif name == "a":
            anchor = 0 if closing else int(i in closes)
        elif name == "br":
            piece.append(" ")
        elif name and name not in INLINE:
            end()
            inside += (-1 if closing else 1) * (name in CONTENT)
            inside = max(0, inside)
        i += 1
    piece.append(page[at:])
    end()
    return out


def _bounded(lines: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """The lines with their articles' edges as gaps, and no empty lines inside articles."""
    out: list[tuple[str, int, bool]] = []
    for line in lines:
        if line[2] and not line[0]:
            continue
        if out and line[2] != out[-1][2]:
            out += [("", 0, line[2])] * BLOCK
        out.append(line)
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    lines = lines_of(page)
    own = sum(n for _, n, inside in lines if inside)
    bounded = 2 * own > sum(n for _, n, _ in lines)
    if bounded:
        lines = _bounded(lines)
    length = [n for _, n, _ in lines]
    sums, total = [], 0
    for i, n in enumerate(length):  # window of the line and the BLOCK - 1 lines after it
        total = sum(length[i : i + BLOCK]) if i == 0 else total - length[i - 1] + (length[i + BLOCK - 1] if i + BLOCK - 1 < len(length) else 0)
        sums.append(total)
    least = SURGE * max(sums, default=0)
    stretches: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        if sums[i] == 0:
            i += 1
            continue
        j = i  # surge
        while j < len(sums) and sums[j] > 0:
            j += 1  # dive
        stretches.append((i, j))
        i = j
    surged = []
    for i, j in stretches:
        outside = bounded and not any(inside and n for _, n, inside in lines[i:j])
        surged.append(max(sums[i:j]) >= (least if outside else min(least, FULL)))
    # runs of stretches that only markup parts; in each, all from the first surge to the last
    kept: list[str] = []
    run: list[int] = []
    for k, (i, j) in enumerate(stretches):
        run.append(k)
        after = stretches[k + 1][0] if k + 1 < len(stretches) else None
        if after is not None and not any(text and not n for text, n, _ in lines[j:after]) and not (bounded and lines[i][2] != lines[after][2]):
            continue
        strong = [r for r in run if surged[r]]
        for i, j in stretches[strong[0] : strong[-1] + 1] if strong else []:
            kept += [text for text, n, _ in lines[i:j] if n > 0]
        run = []
    return "\n".join(kept)


def extract_pages(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``text``, and n_chars, its code points."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars")] if keep is None else keep
    rows = pages.select(*keep, F.col(column).alias("__html"))
    fields = rows.schema.fields[:-1]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["`text` string", "`n_chars` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(len(names))
            texts = [extract(pages[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op4_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
