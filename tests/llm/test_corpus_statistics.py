"""Filter audit, ranked search and language-model scores against slow versions."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequery.llm import context_tree, filter_audit, ranked_search

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "río", "Straße", "x1", "中文", "stone", "light", "PAPER", "under", "a", "b", "c$", "ocean", "ab-cd"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.choice([5, 15, 55])]) for _ in range(rng.choice([0, 1, 3, 30, 230, 260]))]
        out.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words), rng.choice(["en", "de", None, ""])))
    out += [(i + n, out[i % 7][1], "en") for i in range(12)]  # copies
    out += [(3, "repeated id", "de"), (3, out[5][1], "de"), (3, out[5][1], "de"), (None, None, None), (None, out[5][1], "xx"), (n + 50, None, "en"), (n + 51, "", None), (n + 52, "word " * 4000, "de")]
    return out


@pytest.fixture(scope="module")
def rows():
    return made(3, 60)


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = ["part", "digest", "mask", "n", "good", "row", "terms", "tf", "c", "item", "g", "held", "block", "score", "rank"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    return df.select("*", *[F.lit("x").alias(x) for x in names])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


# ------------------------------------------------------------- filter audit
def fails(text, first, i):
    words = BLANK.findall(text)
    out = ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "") + ("E" if i is not None and i > first else "")


def slow_audit(rows, labels):
    known = collections.defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            known[i] = [max(a, int(b == 1)) for a, b in zip(known[i], (quality, toxic))]
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    out = collections.defaultdict(lambda: np.zeros(7, int))
    parts = {lang or "" for _, _, lang in rows}
    for part, order, step in itertools.product(parts, map("".join, itertools.permutations("ABCDE")), range(1, 6)):
        out[part, order, step] += 0
    for i, text, lang in rows:
        bad = fails(text or "", first.get(text or ""), i)
        good, toxic = known[i] if i is not None else (0, 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                own, cell = f in bad, out[lang or "", order, step]
                cell[0] += not gone and not own
                cell[1] += own and not gone
                cell[2] += own and gone
                cell[3] += bad == f
                cell[4] += good * (own and not gone)
                cell[5] += toxic * (own and not gone)
                gone = gone or own
    shares = collections.Counter()
    for (part, order, step), cell in out.items():
        shares[part, order[step - 1]] += cell[1]
    return {k: (*v[:6], shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, docs, rows, nothing):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.OUTCOMES) for r in filter_audit.audit(docs, given).collect()}
    assert got == slow_audit(rows, labels)
    assert filter_audit.audit(nothing, given).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(docs, given.where("false")).collect()} == {0}


def test_matrices_add_up():
    m = filter_audit.matrices()
    assert m["kept"].shape == (32, 600) and len(set(filter_audit.orders())) == 600
    last = [k for k, x in enumerate(filter_audit.orders()) if x[1] == 5]
    assert (m["kept"][0] == 1).all() and (m["kept"][1:, last] == 0).all()
    # A document is removed once in each order, by one filter or another.
    removed = m["removed"].reshape(32, 120, 5).sum(2)
    assert (removed[0] == 0).all() and (removed[1:] == 1).all()


# ------------------------------------------------------------ ranked search
def slow_search(rows, items, most):
    docs = [(i, TERM.findall((t or "").translate(LOWER))) for i, t, *_ in rows]
    docs = [(i, t) for i, t in docs if t]
    n_docs, total = len(docs), sum(len(t) for _, t in docs)
    df = collections.Counter(x for _, t in docs for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in docs:
            tf, m, score = collections.Counter(t), 75 + 25 * len(t) * n_docs // total, 0
            for x in TERM.findall((text or "").translate(LOWER)):
                if tf[x]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("most", "terms", "heads"), [(20, 500_000, 100), (3, 12, 3), (1, 500_000, 1)])
def test_ranked_search(spark, docs, rows, nothing, monkeypatch, most, terms, heads):
    """Also in blocks of queries, and with heads and lookups as short as may be."""
    monkeypatch.setattr(ranked_search, "HEAD", heads)
    monkeypatch.setattr(ranked_search, "LOOKED_UP", heads)
    items = [(0, "The stone of light w3 w4 w4"), (1, "río STRASSE straße 中文"), (2, ""), (3, None), (4, "nowhere"), (5, "w1 w2 w3 w5 w7 w9 w11 w13 ab cd"), (5, "the"), (None, "ocean paper")]
    given = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = sorted([tuple(r) for r in ranked_search.search(docs, given, most, terms).collect()], key=str)
    assert got == slow_search(rows, items, most)
    assert ranked_search.search(nothing, given).count() == 0 and ranked_search.search(docs, given.where("false")).count() == 0


def test_search_reads_lists_only_down_to_the_threshold(spark):
    rows = [(i, "common " * 3 + ("rare words meet here" if i % 100 == 0 else f"other {i}"), "en") for i in range(2000)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string, lang string"), [(0, "common rare words meet here")]
    queries = ranked_search.query_terms(spark.createDataFrame(items, "item_id long, text string"))
    index = ranked_search.Index(df, ranked_search.stash(queries, "queries"))
    assert index.candidates(5).count() <= 20 < 2000
    got = sorted([tuple(r) for r in ranked_search.search(df, spark.createDataFrame(items, "item_id long, text string"), 5).collect()], key=str)
    assert got == slow_search(rows, items, 5)


# ---------------------------------------------------------- language models
def seen_bytes(text):
    return " ".join(BLANK.findall((text or "").translate(LOWER))).encode() + b"\xff"


def slow_scores(texts, known, depth):
    """Context-tree weighting as it is defined, node by node."""
    n, shorter = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(list)
    for text, learn in zip(texts, known):
        data = b"\xff" * depth + seen_bytes(text)
        for i in range(depth, len(data)) if learn else ():
            for d, b in itertools.product(range(depth + 1), range(8)):
                n[data[i - d : i], 1 << b | data[i] >> (8 - b)][data[i] >> (7 - b) & 1] += 1
    for c, u in n:
        if c:
            shorter[c[1:], u].append((c, u))
    log, weight = {}, {}
    for k in sorted(n, key=lambda k: -len(k[0])):
        a, b = n[k]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        longer = sum(log[x] for x in shorter[k])
        log[k] = own if len(k[0]) == depth else np.logaddexp(own, longer) - math.log(2)
        weight[k] = 1.0 if len(k[0]) == depth else 1 / (1 + math.exp(min(700, longer - own)))

    def one(context, u, d):
        k = context[len(context) - d :], u
        if k not in n:
            return None
        kt = (n[k][1] + 0.5) / (sum(n[k]) + 1)
        more = one(context, u, d + 1) if d < depth else None
        return kt if more is None else weight[k] * kt + (1 - weight[k]) * more

    out = []
    for text in texts:
        data, total = b"\xff" * depth + seen_bytes(text), 0.0
        for i in range(depth, len(data)):
            for b in range(8):
                p = one(data[i - depth : i], 1 << b | data[i] >> (8 - b), 0)
                p = 0.5 if p is None else p
                total += math.log10(p if data[i] >> (7 - b) & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_context_tree(spark, block):
    texts = ["Hello  world, hello\tWorld. ", None, "", "abc abd abe ÄÖ ñandú 中文 abc", " x", "Hello worlds and the abcd abc", "aaaa bbbb " * 9, "zq", " ", "hello"] * 2
    ids = [*range(len(texts) - 2), 3, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("keys", F.lit("x")).repartition(3)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    want = slow_scores(texts, [not x for x in out], context_tree.DEPTH)
    tokens = [[*BLANK.findall((t or "").translate(LOWER)), None] for t in texts]
    c = collections.Counter(x for t, x_ in zip(tokens, out) if not x_ for x in t)
    n, v = sum(c.values()), len(c)

    def base(t):
        return sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)

    key = lambda r: (str(r[0]), r[2], r[6])
    want = sorted([(i, h, len(t), sum(c[x] > 0 for x in t), n, base(t), s, len(seen_bytes(x))) for i, h, t, s, x in zip(ids, out, tokens, want, texts)], key=key)
    got = sorted([tuple(r) for r in context_tree.score(df, held, block).collect()], key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:5] + a[7:] == b[:5] + b[7:] and a[5:7] == pytest.approx(b[5:7], abs=1e-4)
    assert context_tree.score(df.where("false"), held).count() == 0


def test_without_training_rows_a_byte_costs_eight_bits(spark):
    df = spark.createDataFrame([(0, "some text"), (1, None)], "doc_id long, text string")
    rows = context_tree.score(df, F.lit(True)).collect()
    assert [r["score"] for r in rows] == pytest.approx([-8 * math.log10(2) * r["n_bytes"] for r in rows], rel=1e-6)
    assert {r["base_score"] for r in rows} == {0.0} and {r["n_known"] for r in rows} == {0}


def test_probabilities_of_a_byte_add_up():
    text, offs = context_tree.stream(np.frombuffer("die der das die der".encode() * 20, np.uint8), np.array([0, 380]))
    keys, counts = context_tree.counted(text, offs, np.array([True]))
    keys, counts = keys[keys < context_tree.WORD], counts[keys < context_tree.WORD]
    every = np.unique((keys[:, None] >> np.uint64(8) << np.uint64(8) | np.arange(256, dtype=np.uint64)[None, :]).ravel())
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, keys)] = counts
    levels = [context_tree.subtree(keys, counts, b)[1][-1] for b in range(8)]
    node, zeros, ones, log = (np.concatenate(x) for x in zip(*[x.shorter() for x in levels]))
    order = np.argsort(node)
    two = context_tree.Level(node[order], zeros[order], ones[order], log[order])
    scores = context_tree.run_scores(every, full, (two.node, two.kt, two.w), context_tree.Top(two.shorter()))
    assert (10**scores).reshape(-1, 256).sum(1) == pytest.approx(1.0)


def test_held_out_text_is_told_better_than_by_words(spark):
    rng = random.Random(5)
    words = {k: ["".join(rng.choice(x) for _ in range(rng.randint(1, 3))) for _ in range(120)] for k, x in (("a", ["ba", "de", "ki"]), ("b", ["so", "un", "är"]))}
    df = spark.createDataFrame([(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(120))) for i in range(300)], "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    r = context_tree.score(df, held).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_places_find_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 5000, dtype=np.uint64))
    assert (context_tree.Places(keys).find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    assert len(context_tree.Places(keys[:0]).find(keys[:0])) == 0
