"""The corpus pipeline, each stage against a brute-force version."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavequery.llm import mixing, pieces, toxicity
from wavequery.llm.common import read_labels, stash

WORDS = "the of and in that it was for with ocean river stone light paper green house seven walking under".split()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    out = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(220):
        w = [rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(20, 70))]
        toxic = int(i % 4 == 1)
        if toxic:
            w += ["idiot", "moron", "worthless", "idiot"]
            rng.shuffle(w)
        rows.append((i, " ".join(w), "en", f"s{i % 4}", None))
        labels.append((i, 1, toxic))
    rows += [(300 + i, rows[4 * i][1], "en", "s0", 5) for i in range(10)]  # exact copies
    rows += [(400 + i, rows[4 * i + 2][1] + " tail", None, None, 5) for i in range(10)]  # near copies
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(out + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(out + "/labels.parquet")
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, read_labels(spark, sf_dir)).collect()} if name == "reject_toxic" else {}
        plan = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()} if name == "mix_sources" else {}
        docs = stash(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = collections.Counter(r["doc_id"] for r in rows)
        assert all(r == before[r["doc_id"]] for r in rows)
        if name == "reject_toxic":
            assert set(kept[name]) == {i for i, p in scored.items() if not p}
            assert sum(1 for i in before if i < 220 and i % 4 != 1 and i not in kept[name]) <= 5
        elif name == "drop_copies":
            last = {}
            for i, r in before.items():
                last[r["text"] or ""] = max(i, last.get(r["text"] or "", -1))
            assert set(kept[name]) == set(last.values())
        elif name == "drop_near_copies":
            sets = {i: shingles(r["text"] or "") for i, r in before.items()}
            groups = {i: {i} for i in before}
            for a in before:
                for b in before:
                    x, y = sets[a], sets[b]
                    if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and groups[a] is not groups[b]:
                        groups[a] |= groups[b]
                        for c in groups[b]:
                            groups[c] = groups[a]
            assert set(kept[name]) == {min(g) for g in groups.values()}
        else:
            assert kept[name] == collections.Counter({i: n for i, n in plan.items() if n})
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.columns == [*columns, "ids", "n_pieces", "exact"]
    coder = pieces.Pieces(pieces.load_model())
    got = out.collect()
    assert collections.Counter(r["doc_id"] for r in got) == kept["mix_sources"]
    assert all(r["exact"] and coder.decode(r["ids"]) == r["text"] for r in got)


def test_run_end_to_end(spark, sf_dir):
    """``run`` gives what its stages give one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    want = collections.Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in docs.collect())
    got = collections.Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and sum(got.values()) > 100


CLASHES = ["n", "k", "c", "key", "label", "score", "_s", "_key", "_size", "_level", "_mix_n", "kept", "region", "u", "root", "size", "copies", "sha"]


def test_odd_rows_through_every_stage(spark, sf_dir, tmp_path):
    """Repeated and missing ids, missing texts and sources, clashing names."""
    rng = random.Random(6)
    one, two, three = (" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(3))
    bad = "idiot moron worthless you idiot " * 5
    rows = [(7, one), (9, one), (7, two), (None, one), (None, two + " tail"), (None, three), (None, bad), (7, bad), (None, None), (8, None), (8, ""), (5, "word"), (5, "word")]
    rows = [(i, t, "en", s, 1) for (i, t), s in zip(rows, ["a", None, "b"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    others = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id between 20 and 219")  # to learn from
    own = {r[1] or "" for r in rows}
    out, left = {}, others.unionByName(docs).select("*", *[F.lit(c).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        columns = left.columns
        left = stash(stage(spark, left, sf_dir), name)
        assert left.columns == columns if name != "encode_pieces" else left.columns[:-3] == columns
        out[name] = [r for r in left.collect() if (r["text"] or "") in own]
        assert all(r[c] == c for r in out[name] for c in CLASHES)
    texts = {name: sorted((r["text"] or "") for r in rows) for name, rows in out.items()}
    assert texts["reject_toxic"] == sorted((r[1] or "") for r in rows if r[1] != bad)
    assert texts["drop_copies"] == sorted({(r[1] or "") for r in rows} - {bad})
    assert {r["doc_id"] for r in out["drop_copies"] if r["text"] == one} == {9}
    assert texts["drop_near_copies"] == sorted({(r[1] or "") for r in rows} - {bad, two + " tail"})
    assert set(texts["mix_sources"]) <= set(texts["drop_near_copies"])
    assert texts["encode_pieces"] == texts["mix_sources"]


def test_empty_table_through_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_very_long_texts_through_every_stage(spark, sf_dir):
    rng = random.Random(8)
    long = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(150_000)), "x" * 1_000_000, "ab " * 400_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*long, long[0] + " tail", long[1], "short text of some words"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    got = {r["doc_id"]: r["exact"] for r in docs.select("doc_id", "exact").collect()}
    assert got and set(got) <= {0, 2, 4, 5} and all(got.values())


def test_near_copies_by_five_words(spark):
    w = [f"w{i}" for i in range(60)]
    v = w[:30] + ["other"] + w[31:]  # 51 of 61 runs of 5 words, 55 of 61 of 3
    u = w[:28] + ["one", "more"] + w[30:]  # 50 of 62 and 54 of 62
    far = w[:20] + ["other"] + w[21:40] + ["other"] + w[41:]  # 46 of 66
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(u)), (4, " ".join(far[::-1])), (5, " ".join(w[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {1, 4, 5}
