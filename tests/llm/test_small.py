"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvigil.llm import chat, contamination, html_text, jaccard, langid, mixing, neighbours, passages, sharding, suffixes
from sparkvigil.llm.common import Stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rand_words(seed, n, vocabulary=5000):
    r = np.random.default_rng(seed)
    return [f"w{x}é" if x % 7 == 0 else f"w{x}" for x in r.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    base = [rand_words(i, 60 + 37 * i % 400) for i in range(24)]
    passage = rand_words(999, 70)
    texts = [" ".join(b) for b in base]
    texts += [texts[3], texts[3], texts[4].upper(), texts[5].replace(" ", "\n ")]
    for i in range(6, 14):  # near copies
        b = list(base[i])
        b[len(b) // 2] = "changed"
        texts.append("\t".join(b))
    for i in (0, 1, 2, 17):
        texts.append(" ".join(base[i][:20] + passage + base[i][20:]))
    texts += ["", " \n\t ", None, None, "one two", "one  two", "x", "a " * 3000, "".join("ab" * 900), " ".join(rand_words(77, 30_000)), "ñandú " + "é" * 500]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[2], (None, texts[3]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use themselves, over several partitions."""
    df = spark.createDataFrame([(i, t, f"s{k % 3}" if k % 5 else None, "en" if k % 2 else None, len(t or ""), k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long, size long, cls string")
    return df.repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter(F.lit(False))


def words(text):
    return WORD.findall(text or "")


def table_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- 8 ----


def plain_join(rows):
    sets = []
    for i, t in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(((i, len(s), least.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def test_jaccard_is_brute_force(spark, docs, rows):
    got = table_of(jaccard.join_components(docs, Stage(spark, "t")), "doc_id", "n_shingles", "component_id")
    assert got == plain_join(rows)


def test_jaccard_families(spark):
    """A family beyond RARE: its shingles are frequent, some of its members only reach each other in steps."""
    base = rand_words(5, 200)
    rows = []
    for i in range(60):
        b = list(base)
        for k in range(i % 12):
            b[(17 * k + i) % 200] = f"n{i}_{k}"
        rows.append((i, " ".join(b)))
    rows += [(100 + i, " ".join(base[:150] + rand_words(50 + i, 8 * i))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table_of(jaccard.join_components(df, Stage(spark, "t")), "doc_id", "n_shingles", "component_id") == plain_join(rows)


def just_under(n=150, members=70, changes=4):
    """A base, copies of it with up to as many changed words as keep them linked, and more that all lie just under the threshold
    of each other; every size differs a little."""
    base = rand_words(7, n)
    rows = [(0, " ".join(base))]
    for i in range(1, members):
        b = list(base)
        far = i % 3 == 0
        for k in range(changes if far else i % changes):
            b[(37 * k + 11 * i) % n] = f"s{k}" if i % 7 == 0 else f"m{i}_{k}"
        rows.append((i, " ".join(b[: n - i % 4])))
    return rows


def plain_links(rows):
    """Sets of equal texts' ids and the pairs of ids linked."""
    sets = {i: {tuple(words(t.lower())[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t in rows}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("changes", [3, 4, 5])
def test_jaccard_just_under(spark, changes):
    rows = just_under(changes=changes) + [(1000 + i, t) for i, t in just_under(n=40, changes=changes - 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table_of(jaccard.join_components(df, Stage(spark, "t")), "doc_id", "n_shingles", "component_id") == plain_join(rows)


@pytest.mark.parametrize("changes", [2, 4])
def test_jaccard_pairs(spark, changes):
    rows = just_under(changes=changes)
    members, links = jaccard.join_pairs(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark, "t"))
    of = {}
    for r in members.collect():
        of.setdefault(r["cls"], []).append(r["doc_id"])
    got = {tuple(sorted((x, y))) for r in links.collect() for x in of[r["a"]] for y in of[r["b"]]}
    got |= {(x, y) for m in of.values() for x in m for y in m if x < y}
    assert got == plain_links(rows)


def test_jaccard_long_family(spark):
    """Documents of 60,000 words, all of whose shingles are frequent, just under and just over the threshold."""
    base = rand_words(9, 60000)
    rows = []
    for i in range(20):
        b = list(base)
        for k in range(1100 + 30 * i):
            b[(53 * k + 7 * i) % 60000] = f"x{i}_{k}"
        rows.append((i, " ".join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table_of(jaccard.join_components(df, Stage(spark, "t")), "doc_id", "n_shingles", "component_id") == plain_join(rows)


def test_jaccard_edges(spark, empty):
    assert jaccard.join_components(empty, Stage(spark, "t")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert table_of(jaccard.join_components(one, Stage(spark, "t")), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]


# ---- 6 ----


def plain_passages(rows, n=50):
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(order(i), first.get(key, float("inf")))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < order(i):
                gone |= set(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_passages_are_brute_force(spark, docs, rows):
    assert table_of(passages.dedup_passages(docs, Stage(spark, "t")), "doc_id", "n_words", "n_removed", "text") == plain_passages(rows)


def test_difference_cover():
    """Any two positions have a shift below the period that brings both into the cover."""
    p, c = passages.PERIOD, set(passages.COVER)
    assert all(any((a + s) % p in c and (b + s) % p in c for s in range(p)) for a in range(p) for b in range(p))


def test_passages_edges(spark, empty):
    assert passages.dedup_passages(empty, Stage(spark, "t")).count() == 0
    with pytest.raises(ValueError):
        passages.dedup_passages(empty, Stage(spark, "t"), window=10)


# ---- 9 ----


def plain_bytes(rows, n):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k : k + n] for _, x in raw for k in range(len(x) - n + 1))
    out = []
    for i, x in raw:
        gone = set()
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone |= set(range(k, k + n))
        spans = sum(k - 1 not in gone for k in gone)
        out.append((i, len(x), len(gone), spans, hashlib.sha256(bytes(b for k, b in enumerate(x) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "gram"), [(400, 100), (40, 10)])
def test_bytes_are_brute_force(spark, docs, rows, n, gram):
    short = [(i, t if t is None or len(t) < 20_000 else t[:9_000]) for i, t in rows]
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    got = suffixes.dedup_bytes(df, Stage(spark, "t"), n, gram).select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n"), F.sha2("kept", 256).alias("h"))
    assert table_of(got, "doc_id", "n_bytes", "n_removed", "n", "h") == plain_bytes(short, n)


def test_long_documents_in_pieces(spark, monkeypatch):
    from sparkvigil.llm import kernels

    text = " ".join(rand_words(1, 3000))
    monkeypatch.setattr(kernels, "CHUNK", 2000)
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(suffixes._pieces(data, np.array([0, len(data)]), 400))
    got = [np.stack([a + base, f + base, e + base], 1) for _, base, d, o in parts for _, _, a, f, e in [suffixes._anchored(d, o, 400, 100)]]
    starts = np.concatenate([np.arange(f, e + 1) for x in got for _, f, e in x])
    assert sorted(starts) == list(range(len(data) - 399))


def test_bytes_of_documents_longer_than_a_chunk(spark):
    """A copied passage over the border of a chunk, found by aligning the documents where it is known to stand."""
    from sparkvigil.llm import kernels

    long = " ".join(f"w{x}" for x in np.random.default_rng(4).integers(0, 1 << 40, 90_000))
    at = kernels.CHUNK - 700
    assert len(long) > kernels.CHUNK + 5000
    other = "start " + long[at : at + 2000] + " end"
    lo, hi = at, at + 2000  # of long; the copy may go on by chance
    while other[6 + lo - at - 1] == long[lo - 1]:
        lo -= 1
    while other[6 + hi - at] == long[hi]:
        hi += 1
    rows = [(1, long), (2, other), (3, long[: 300])]
    got = suffixes.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark, "t")).collect()
    spans = {r["doc_id"]: list(r["spans"]) for r in got}
    assert spans == {1: [lo, hi], 2: [6 + lo - at, 6 + hi - at], 3: []}
    assert {r["doc_id"]: bytes(r["kept"]).decode() for r in got}[1] == long[:lo] + long[hi:]


def test_bytes_edges(spark, empty):
    assert suffixes.dedup_bytes(empty, Stage(spark, "t")).count() == 0


# ---- 5 ----


def test_contamination_is_brute_force(spark, docs, rows):
    base = [words(t) for _, t in rows[:8]]
    items = [(1, " ".join(base[0][5:40])), (2, " ".join(base[1][:30]).upper()), (3, "not in any of them at all"), (4, None), (5, ""), (6, "one two"), (7, " ".join(base[2][:28] + ["zz", "yy"])), (1, "x"), (None, " ".join(base[3][10:26]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    want = []
    for i, t in rows:
        w = low(t)
        for j, text in items:
            q = low(text)
            k = min(5, len(q))
            if not k:
                continue
            own, held = {tuple(q[a : a + k]) for a in range(len(q) - k + 1)}, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
            if 100 * len(own & held) >= 80 * len(own):
                want.append((i, j, len(own), len(own & held)))
    got = contamination.find_items(docs, df)
    assert table_of(got, "doc_id", "item_id", "n_item", "n_shared") == sorted(want, key=repr) and want
    clean = contamination.drop_contaminated(docs, df)
    assert clean.columns == docs.columns
    bad = {i for i, *_ in want}
    assert Counter(r[0] for r in clean.select("doc_id").collect()) == Counter(i for i, t in rows if i not in bad) or None in bad


def test_contamination_edges(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.find_items(docs, none).count() == 0 and contamination.drop_contaminated(docs, none).count() == docs.count()
    assert contamination.find_items(empty, none).count() == 0


# ---- 3 ----


def test_targets_are_the_resharing_rule(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 20):
        sizes = [int(x) for x in rng.integers(0, 1000, n) ** 2 // (1 + rng.integers(0, 5, n) * 50)]
        df = spark.createDataFrame([(f"s{i:02}", s, i % 3 + 1) for i, s in enumerate(sizes)], "source string, source_size long, weight long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want, capped, left = {}, set(), float(sum(sizes))
        while True:  # share, cap, share the rest again
            free = [i for i in range(n) if i not in capped]
            pool = left - sum(3 * sizes[i] for i in capped)
            total = sum(i % 3 + 1 for i in free)
            want = {i: pool * (i % 3 + 1) / total for i in free} | {i: 3.0 * sizes[i] for i in capped}
            over = {i for i in free if want[i] > 3 * sizes[i]}
            if not over:
                break
            capped |= over
        assert got == pytest.approx({f"s{i:02}": want[i] for i in range(n)})


def test_mix(spark, docs, empty, rows):
    plan = mixing.mix(docs, Stage(spark, "t")).collect()
    assert len(plan) == len(rows)
    by = defaultdict(list)
    for r in plan:
        by[r["source"]].append(r)
    assert set(by) == {None, "s0", "s1", "s2"}
    for rs in by.values():
        assert sum(r["taken"] for r in rs) == int(rs[0]["target"]) and all(r["taken"] <= 3 * r["size"] for r in rs)
    assert table_of(mixing.mix(docs.repartition(2), Stage(spark, "t")), "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in plan), key=repr)
    assert mixing.mix(empty, Stage(spark, "t")).count() == 0
    once = spark.createDataFrame(docs.dropDuplicates(["doc_id"]).collect(), docs.schema)
    made = mixing.apply_mix(once, Stage(spark, "t"))
    assert made.columns == docs.columns
    want = {r["doc_id"]: r for r in mixing.mix(once, Stage(spark, "t")).collect()}
    held = defaultdict(list)
    for r in made.collect():
        held[r["doc_id"]].append(len(words(r["text"])))
    for i, r in want.items():
        assert sum(held[i]) == r["taken"] and (r["size"] or held[i] == [0])


# ---- 7 ----


def test_shards(spark, docs, empty, rows):
    out = sharding.shard(docs, Stage(spark, "t"), carry=("source", "cls")).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert {r["cls"] for r in out} == {"x"} and sharding.shard(empty, Stage(spark, "t")).count() == 0


def test_groups_stay_together_and_hot_groups_split(spark):
    rows = [(i, f"text {i % 400}" if i < 1200 else ("hot" if i < 2400 else f"single {i}")) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark, "t")).collect()
    text = dict(rows)
    where = defaultdict(Counter)
    for r in out:
        where[text[r["doc_id"]]][r["shard"]] += 1
    counts = Counter(r["shard"] for r in out)
    assert set(counts.values()) == {500}
    cut = sum(len(where[f"text {i}"]) > 1 for i in range(400))
    assert cut <= 40  # at random nearly all groups of three would be cut
    assert 250 < max(where["hot"].values()) <= 500  # drawn together as far as a quota goes
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), Stage(spark, "t")).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out}


@pytest.mark.parametrize(("linked", "size"), [(4000, 2), (3800, 5)])
def test_groups_stay_together_where_nearly_all_rows_are_linked(spark, linked, size):
    rows = [(i, f"text {i % (linked // size)}" if i < linked else f"single {i}") for i in range(4000)]
    text, where, counts = dict(rows), defaultdict(set), Counter()
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), Stage(spark, "t")).collect():
        where[text[r["doc_id"]]].add(r["shard"])
        counts[r["shard"]] += 1
    assert set(counts.values()) == {500}
    cut = sum(len(v) > 1 for v in where.values()) / (linked // size)
    assert cut <= 0.25, cut


# ---- 2 ----


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "\\", "<\\|", "<|im_end|>\n", "a\\<|x|>\\\\|>", "", "<<SYS>>\n<</SYS>>", "<s><s>[[INST]", "é\n\n日本"])
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("b", chat.unescape(F.col("e")))
    r = df.first()
    assert r["b"] == text and not any(m in r["e"] for m in chat.CONTROL)


def plain_fold(log):
    """One event after the other."""
    messages, order = {}, []
    for seq, msg, op, role, text in sorted(log):
        if msg not in messages:
            messages[msg] = [role, ""]
            order.append(msg)
        if op in ("message", "edit"):
            messages[msg][1] = text
            if op == "message":
                messages[msg][0] = role
        elif op == "delta":
            messages[msg][1] += text
        else:
            messages[msg][1] = ""
            for m in order[order.index(msg) + 1 :]:
                del messages[m]
            order = order[: order.index(msg) + 1]
    return [(messages[m][0], messages[m][1]) for m in order]


def test_fold(spark):
    log = [
        (1, 1, "message", "user", "hi <|im_end|>"), (2, 2, "message", "assistant", ""), (3, 2, "delta", "", "he"), (4, 2, "delta", "", "llo"), (5, 3, "message", "user", "more"), (6, 1, "edit", "", "hi!"),
        (7, 2, "regenerate", "", ""), (8, 2, "delta", "", "good day"), (9, 4, "message", "user", "bye\\"), (10, 5, "message", "assistant", "[/INST]"),
    ]
    df = spark.createDataFrame([(1, *e[:3], *e[3:]) for e in log] + [(2, None, None, None, None, None), (None, 1, 1, "message", "user", "x")], "conv_id long, seq long, msg_id long, op string, role string, text string")
    out = {r["conv_id"]: r for r in chat.chat_format(df.repartition(3)).withColumn("read", chat.parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == plain_fold(log) == [tuple(t) for t in out[1]["read"]]
    assert [tuple(t) for t in out[2]["turns"]] == [("", "")] and [tuple(t) for t in out[None]["turns"]] == [("user", "x")]
    assert "".join(s["text"] for s in out[1]["segments"]) == out[1]["formatted"]
    assert [s["text"] for s in out[1]["segments"] if s["loss"]] == ["good day", "[\\/INST]"]
    assert chat.chat_format(df.filter(F.lit(False))).count() == 0


def test_fold_after_a_cut(spark):
    """Random logs with regenerations, restarts after them and events of one seq, against one event after the other."""
    logs = {1: [(1, 1, "message", "user", "a"), (2, 2, "message", "assistant", "b"), (3, 3, "message", "user", "c"), (4, 2, "regenerate", "", ""), (5, 2, "delta", "", "bb"), (6, 3, "message", "user", "cc")]}
    rng = random.Random(3)
    for conv in range(2, 300):
        ties = conv % 3 == 0
        logs[conv] = [
            (rng.randrange(12) if ties else k, rng.randrange(5), rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), f"t{k}")
            for k in range(rng.randrange(1, 14))
        ]
    df = spark.createDataFrame([(c, *e) for c, log in logs.items() for e in log], "conv_id long, seq long, msg_id long, op string, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.fold(df).collect()}
    assert got == {c: plain_fold(log) for c, log in logs.items()} and len(got[1]) == 3


# ---- 4 ----


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id='main-menu'>Menu two</div><article><h1>Head&nbsp;line &amp; more</h1><p>First   <b>bold</b>
text.<script>var t = "</p>";</script></p><div class="ad">Buy</div><p>Short.</p><form><input name=q> Search</form><blockquote>Quote &lt;x&gt;</blockquote></article>
<aside>Side</aside><section class="comments"><p>Reader says a long thing indeed</p></section><footer>&copy; us</footer></body></html>"""


def test_pages():
    assert html_text.extract(PAGE) == "Head line & more\nFirst bold text.\nShort.\nQuote <x>"
    assert html_text.extract(None) == "" == html_text.extract("") == html_text.extract("<nav>only</nav>")
    no_article = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First bold text." in html_text.extract(no_article) and "Menu" not in html_text.extract(no_article)
    assert html_text.extract("<article><p>open <div class=ad>never closed <p>text") == "open\nnever closed\ntext"
    assert html_text.extract("plain & simple") == "plain & simple"


LONG = ["The first paragraph of the body is a long one, " + "with words and words " * n + "to its end." for n in (20, 30, 25)]


def test_pages_without_articles():
    """Whole texts: surge and dive decide, and what is left out parts nothing."""
    whole = "Head line & more\nFirst bold text.\nShort.\nQuote <x>"
    assert html_text.extract(PAGE.replace("<article>", "<div>").replace("</article>", "</div>")) == whole
    ad, menu = "<div class=ad><p>Buy</p></div>", "<ul>" + "<li><a href=/a>Menu</a></li>" * 4 + "</ul>"
    body = f"<div><p>{LONG[0]}</p>{ad}<p>Short.</p>{ad}<p>{LONG[1]}</p></div>{ad}<div><p>{LONG[2]}</p></div>"
    want = "\n".join([LONG[0], "Short.", *LONG[1:]])
    assert html_text.extract(f"<body><div>Site</div>{menu}{body}{menu}<div>Copyright us</div></body>") == want
    assert html_text.extract("<div><p>One.</p></div>".join(f"<div><div><p>{t}</p></div></div>" for t in LONG)) == "\nOne.\n".join(LONG)  # short ones between long ones
    huge = "word " * 2000
    assert html_text.extract(f"<p>{huge}</p>{menu}<p>{LONG[0]}</p>") == huge.strip() + "\n" + LONG[0]  # FULL


def test_an_article_is_a_boundary_only_with_most_text():
    menu = "<ul>" + "<li><a href=/a>Menu</a></li>" * 4 + "</ul>"
    body = "".join(f"<div><p>{t}</p></div>" for t in LONG)
    assert html_text.extract(f"<body>{body}{menu}<article><h3>Related</h3><p>A teaser.</p></article></body>") == "\n".join(LONG)
    assert html_text.extract(f"<body><p>Crumb</p><article><h1>Head</h1>{body}<section><div><p>End.</p></div></section></article><p>Copyright us</p></body>") == "\n".join(["Head", *LONG, "End."])
    assert html_text.extract(f"<p>{LONG[0]}</p><article><p>{LONG[1]}</p></article><p>Copyright us</p>") == "\n".join(LONG[:2])  # outside, decided by its sums


def test_pages_as_they_come():
    text = "The body of this page is a plain text of some length, long enough to count."
    assert html_text.extract(f"<html><head><title>T</title><meta name=a><body><p>{text}</p></body></html>") == text  # head without an end
    for name in ("noscript", "template", "iframe", "svg", "textarea", "title"):
        assert text in html_text.extract(f"<body><{name}><p>{text}</p></body>")
    comment = f"<article class=comment><p>A reader says: {text}</p></article>"
    assert html_text.extract(f"<body><div><p>{text}</p></div>{comment}</body>") == text
    assert html_text.extract(f"<body><article><p>{text}</p></article>{comment}</body>") == text
    assert html_text.extract(f"<body><div class='content-with-sidebar'><p>{text}</p></div><div class=right-sidebar>Side</div></body>") == text
    assert html_text.extract(f"<form id=all><div><p>{text}</p><input name=q></div></form>") == text
    assert html_text.extract(f"<div class=search-page><main><p>{text}</p></main></div>") == text
    assert html_text.extract(f"<p>{text} foo<!-- c -->bar<script>x</script>baz</p>") == f"{text} foobarbaz"
    assert html_text.extract(f"<p title='a > b' lang=x>{text}</p><!-- never closed {text}") == text
    assert html_text.extract(f"<p title='never closed>{text}</p>") == text
    assert html_text.extract(f"<p>{text} 1 < 2 <3</p>") == f"{text} 1 < 2 <3"


@pytest.mark.parametrize("piece", ["a <b ", "<a b='c ", '<a b="c', "<!-- ", "<title>", "<script", "<p class=", "<div><p>word ", "</", "&lt", "<textarea>", "< ", "a<!--->"])
def test_pages_malformed_at_a_megabyte(piece):
    began = time.time()
    html_text.extract(piece * ((1 << 20) // len(piece)))
    assert time.time() - began < 20


def plain_stretches(lines, block=3, surge=0.3):
    """Lines kept of a page whose lines all hold text or nothing, by plain sums over each window."""
    sums = [sum(lines[i : i + block]) for i in range(len(lines))]
    least = min(surge * max(sums, default=0), 80 * block)
    kept, at = set(), 0
    while at < len(sums):
        to = at
        while to < len(sums) and sums[to] > 0:
            to += 1
        if to > at and max(sums[at:to]) >= least:
            kept.add((at, to))
        at = max(to, at + 1)
    if not kept:
        return []
    lo, hi = min(a for a, _ in kept), max(b for _, b in kept)
    return [i for i in range(lo, hi) if lines[i]]


@pytest.mark.parametrize("seed", range(20))
def test_surge_and_dive_are_plain_sums(seed):
    """Pages of blocks and gaps of empty blocks, without any tag or class that says what they are."""
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randrange(1, 12)):
        texts += [" ".join(["w%d" % rng.randrange(99)] * rng.choice([1, 3, 30, 60])) for _ in range(rng.randrange(1, 5))] + [""] * rng.choice([0, 2, 4, 6])
    page = "".join(f"<p>{t}" for t in texts)
    got = html_text.extract(page)
    assert got == "\n".join(texts[i - 1] for i in plain_stretches([0, *map(len, texts)]))


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old", 5), (1, "u", PAGE, "old", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract_pages(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 50, 50] and html_text.extract_pages(df.filter(F.lit(False))).count() == 0


# ---- 1 ----


def test_language(spark, empty):
    vocabulary = {"aa": "the and of thing ondly sherein", "bb": "der und nicht schön über ein", "cc": "le élan être que vous dans"}
    rng = np.random.default_rng(0)
    rows = [(i * 3 + k, " ".join(rng.choice(v.split(), rng.integers(1, 200))), lang) for i in range(60) for k, (lang, v) in enumerate(vocabulary.items())]
    train = spark.createDataFrame([r for r in rows if r[0] % 4], "doc_id long, text string, lang string")
    model = langid.train(train)
    held = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows if i % 4 == 0] + [(-1, None, "aa"), (-2, "", None), (-3, "12 %% 7", "aa"), (-4, "ξψ ωω ΞΞΨ ζζ " * 40, None), (None, "the and", "cc")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(held.withColumn("score", F.lit("old")).drop("score"), model).collect()}
    want = {i: lang for i, _, lang in rows if i % 4 == 0}
    assert sum(got[i]["lang_pred"] == want[i] for i in want) / len(want) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[i]["rejected"] for i in want)
    assert [(got[i]["lang_pred"], got[i]["rejected"]) for i in (-1, -2, -3)] == [("und", True)] * 3 and got[-4]["rejected"] and got[-4]["lang_pred"] in vocabulary
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(held, nothing).collect()} == {"und"} and langid.identify(empty, model).count() == 0


OTHERS = {
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_unseen_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold_of(F.col("doc_id")) == 1
    model = langid.train(docs.filter(~held))
    rng = np.random.default_rng(4)
    letters = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n))
    for n in (30, 120, 500):
        foreign = {k: " ".join(rng.choice(v.split(), n)) for k, v in OTHERS.items()}
        foreign |= {"letters": letters(n), "base64": base64.b64encode(rng.bytes(5 * n)).decode()}
        assert [k for k, t in foreign.items() if not model.predict(t)[2]] == []
    told = [model.predict(r["text"]) for r in docs.filter(held).collect() if langid.has_letter(r["text"])]
    assert sum(t[2] for t in told) <= 0.005 * len(told)


def test_grams_see_whole_texts(monkeypatch):
    text = " ".join(rand_words(3, 2000))
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert (langid.grams(text) == whole).all()


# ---- 10 ----


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:1100] = x[100]  # a third are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] * 8), (None, [1.0] * 16), (5400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df, df.filter("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    hits = total = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert [f[0] for f in found] == list(range(1, 11)) and [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        hits += len({f[1] for f in found} & set(want))
        total += 10
        if 100 <= q < 1100:
            assert [f[1] for f in found] == want
    assert hits / total >= 0.9
    few = df.filter("vec_id < 5")
    assert neighbours.search(few, few.filter("vec_id = 0")).count() == 4 and neighbours.search(df.filter(F.lit(False)), df.filter(F.lit(False))).count() == 0
