"""Toxicity: gradient-boosted trees over dense features, calibrated.

Features of a text: densities of a fixed and of a learned lexicon, their
proximity to second-person words, capitals, punctuation and obfuscation rates.
Lexicon, trees and calibration are learned from at most ``TRAIN_ROWS`` labelled
rows, those of the smallest hashes, so the model's size and training time don't
grow with the corpus; every whole text is then scored on the executors, where
the model (some kB) goes with the task.  A quarter of the training rows is kept
from lexicon and trees and fits the isotonic calibration.  The others are dealt
to two halves: the trees see each half by the lexicon of the other one, so no
row is described by words that its own label chose.

Edge cases: null text is empty and scored like any other; without labelled rows
of both classes the score is the share of label 1 (0 without any label); rows
of ``labels`` without id or label are left out, repeated ones count once (the
largest label); repeated documents, and rows without a doc_id, are scored each;
texts of over ``STEP`` bytes are read in pieces (a word that a cut of a run
without white space divides counts as two, words meet second persons within
their piece); an empty table gives an empty result; other columns, whatever
their names, are ignored by ``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _LOWER, arrow_bytes, map_arrow, read_documents, read_labels, release, row_steps, segments, span_hashes, spans_of, stash, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_ROWS, THRESHOLD = 12_000, 0.3
TREES, DEPTH, RATE, BINS, REGULAR = 80, 3, 0.15, 64, 1.0
LEARNED, LEAST_DOCS = 300, 4

LEXICON = (
    "idiot idiots moron morons stupid dumb dumbass fool scum trash garbage loser losers pathetic worthless disgusting clown "
    "filth vermin ugly hate kill die jerk bastard bitch shit fuck fucking asshole crap imbecile cretin retard"
).split()
SECOND_PERSON = "you your yours yourself u ur du dein deine dich dir ihr euch tu te toi ton ta vous votre tú usted eres".split()
NEAR = 5

FEATURES = (
    "lexicon", "lexicon_any", "learned", "learned_best", "learned_kinds", "second", "near", "capitals", "shouting",
    "marks", "exclaiming", "obfuscated", "unmasked", "log_words", "word_length",
)

_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MASK = np.zeros(256, bool)
_MASK[[ord(c) for c in "0134578@$*"]] = True
_UNMASK = _LOWER.copy()
for _a, _b in zip("0134578@$", "oieastbas"):
    _UNMASK[ord(_a)] = ord(_b)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def hash_words(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(b) for b in raw])
    return np.unique(span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(b) for b in raw], end))


_INSULTS, _SECOND = hash_words(LEXICON), hash_words(SECOND_PERSON)


def _found(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table) or not len(hashes):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return np.where(table[at] == hashes, at, -1)


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


#: What is counted in a piece of text, in this order.
(_WORDS, _BYTES, _INSULT, _GAIN, _SECONDS, _CLOSE, _LETTERS, _CAPITALS, _SHOUTS, _MARKS, _EXCLAIMS, _HIDDEN, _SEEN) = range(13)


def _counts(data: np.ndarray, offs: np.ndarray, learned: np.ndarray, weights: np.ndarray):
    """Counts of every piece, its best gain, and (piece, learned word) pairs."""
    out = np.zeros((len(offs) - 1, 13))
    wordy, upper = _WORDY[data], _UPPER[data]
    start, end, first = spans_of(wordy, offs)
    hashes = span_hashes(_LOWER[data], start, end)
    insult, second = _found(_INSULTS, hashes) >= 0, _found(_SECOND, hashes) >= 0
    at = _found(learned, hashes)
    gain = np.where(at >= 0, weights[at] if len(weights) else 0.0, 0.0)
    row = np.searchsorted(first, np.arange(len(start)), "right") - 1
    spread = np.zeros(len(start) + 1, np.int64)
    hits = np.flatnonzero(second)
    np.add.at(spread, np.maximum(first[row[hits]], hits - NEAR), 1)
    np.add.at(spread, np.minimum(first[row[hits] + 1], hits + NEAR + 1), -1)
    capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int32)])
    out[:, _WORDS], out[:, _BYTES] = np.diff(first), np.diff(offs)
    out[:, _INSULT], out[:, _GAIN], out[:, _SECONDS] = _per_row(insult, first), _per_row(gain, first), _per_row(second, first)
    out[:, _CLOSE] = _per_row((np.cumsum(spread[:-1]) > 0) & (insult | (gain > 1.0)), first)
    out[:, _LETTERS], out[:, _CAPITALS] = _per_row(_LETTER[data], offs), _per_row(upper, offs)
    out[:, _SHOUTS] = _per_row((capital[end] - capital[start] == end - start) & (end - start >= 3), first)
    out[:, _MARKS] = _per_row(~wordy & (data > 0x20), offs)
    out[:, _EXCLAIMS] = _per_row((data == 0x21) | (data == 0x3F), offs)
    best = np.zeros(len(offs) - 1)
    if len(start):
        full = np.flatnonzero(np.diff(first) > 0)
        best[full] = np.maximum.reduceat(gain, first[:-1][full])
    pairs = np.unique(row[at >= 0] * (len(learned) + 1) + at[at >= 0])
    start, end, first = spans_of(wordy | _MASK[data], offs)
    masked = np.concatenate([[0], np.cumsum(_MASK[data], dtype=np.int32)])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
    hidden = (masked[end] > masked[start]) & (letter[end] > letter[start])
    seen = np.zeros(len(start))
    seen[hidden] = _found(_INSULTS, span_hashes(_UNMASK[data], start[hidden], end[hidden])) >= 0
    out[:, _HIDDEN], out[:, _SEEN] = _per_row(hidden, first), _per_row(seen, first)
    return out, best, pairs


def features(data: np.ndarray, offs: np.ndarray, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for every text, about STEP bytes at a time."""
    rows, width = len(offs) - 1, len(learned) + 1
    cuts, of = segments(data, offs, hard=True)
    n, best, kinds = np.zeros((rows, 13)), np.zeros(rows), []
    for i, j in row_steps(cuts):
        counts, most, pairs = _counts(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], learned, weights)
        np.add.at(n, of[i:j], counts)
        np.maximum.at(best, of[i:j], most)
        kinds.append(np.unique(of[i + pairs // width] * width + pairs % width))
    kinds = np.bincount(np.unique(np.concatenate(kinds)) // width, minlength=rows) if kinds else np.zeros(rows)
    words, size = np.maximum(1, n[:, _WORDS]), np.maximum(1, n[:, _BYTES])
    out = np.zeros((rows, len(FEATURES)))
    out[:, 0], out[:, 1] = n[:, _INSULT] / words, np.log1p(n[:, _INSULT])
    out[:, 2], out[:, 3], out[:, 4] = n[:, _GAIN] / words, best, kinds / np.sqrt(words)
    out[:, 5], out[:, 6] = n[:, _SECONDS] / words, n[:, _CLOSE] / words
    out[:, 7], out[:, 8] = n[:, _CAPITALS] / np.maximum(1, n[:, _LETTERS]), n[:, _SHOUTS] / words
    out[:, 9], out[:, 10] = n[:, _MARKS] / size, n[:, _EXCLAIMS] / size
    out[:, 11], out[:, 12] = n[:, _HIDDEN] / words, n[:, _SEEN] / words
    out[:, 13], out[:, 14] = np.log1p(words), n[:, _LETTERS] / words
    return out


# ---------------------------------------------------------------- learning
def grow(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the logistic loss, on binned features.  A tree is an
    array of (feature, threshold, value) in heap order."""
    prior = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = {"start": float(np.log(prior / (1 - prior))), "trees": []}
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    score = np.full(len(y), model["start"])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        tree = np.zeros((2 ** (DEPTH + 1) - 1, 3))
        tree[:, 0] = -1
        for level in range(DEPTH):
            base, width = 2**level - 1, 2**level
            best = [(1e-6, -1, 0)] * width
            for f in range(x.shape[1]):
                key = (node - base) * BINS + binned[:, f]
                sg = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                sh = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + REGULAR) + (tg - sg) ** 2 / (th - sh + REGULAR) - tg**2 / (th + REGULAR)
                gain[(sh < 1.0) | (th - sh < 1.0)] = 0
                cut = gain.argmax(1)
                for k in range(width):
                    if gain[k, cut[k]] > best[k][0] and cut[k] < len(edges[f]):
                        best[k] = (gain[k, cut[k]], f, int(cut[k]))
            right = np.zeros(len(y), np.int64)
            for k, (_, f, cut) in enumerate(best):
                if f >= 0:
                    tree[base + k, :2] = f, edges[f][cut]
                    right[node == base + k] = binned[node == base + k, f] > cut
            node = 2 * node + 1 + right
        base, width = 2**DEPTH - 1, 2**DEPTH
        sg, sh = np.bincount(node - base, g, width), np.bincount(node - base, h, width)
        tree[base:, 2] = -RATE * sg / (sh + REGULAR)
        score += tree[node, 2]
        model["trees"].append(tree)
    return model


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for tree in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = tree[node, 0].astype(np.int64)
            node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > tree[node, 1]))
        score += tree[node, 2]
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising function of the raw score."""
    blocks: list[list[float]] = []  # mean label, rows, sum of scores
    for s, v in sorted(zip(score.tolist(), y.tolist())):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, s2 = blocks.pop()
            v1, n1, s1 = blocks[-1]
            blocks[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, s1 + s2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def calibrated(model: dict, raw: np.ndarray) -> np.ndarray:
    """Interpolated between knots; a hundredth of the plain logistic score is
    mixed in, so that equal calibrated values keep their order."""
    plain = 1 / (1 + np.exp(-raw))
    x, y = model["knots"]
    return 0.99 * np.interp(raw, x, y) + 0.01 * plain if len(x) else plain


#: Eighths of the training rows: two for the calibration, three for each half.
ASIDE, ONE, TWO, BOTH = (0, 1), (2, 3, 4), (5, 6, 7), (2, 3, 4, 5, 6, 7)


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> dict:
    """The model from labelled rows (doc_id, label)."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = stash(labels.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most), "chosen", True)
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(8)).cast("int").alias("part")
    sample = stash(docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("*", part), "sample")
    known = _lexicons(sample)
    by_part = {p: known[TWO if p in ONE else ONE if p in TWO else BOTH] for p in range(8)}

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        parts, x = np.asarray(batch.column("part")), np.zeros((batch.num_rows, len(FEATURES)))
        for group in (ASIDE, ONE, TWO):
            own = np.isin(parts, group)
            if own.any():
                x[own] = features(data, offs, *by_part[group[0]])[own]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "part": batch.column("part"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    table = map_arrow(sample, rows, "doc_id long, label int, part int, x array<double>").toPandas().sort_values("doc_id")
    release(chosen, sample)
    x = np.stack(table.x.to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    y = table.label.to_numpy(np.float64)
    aside = np.isin(table.part.to_numpy(), ASIDE)
    learned, weights = known[BOTH]
    model = grow(x[~aside], y[~aside]) | {"learned": learned, "weights": weights}
    model["knots"] = isotonic(raw_scores(model, x[aside]), y[aside]) if aside.any() and model["trees"] else (np.zeros(0), np.zeros(0))
    return model


def _lexicons(sample: DataFrame) -> dict:
    """For each half of the training rows and for both: words (by hash) that
    mark label 1, from document counts by label; the LEARNED strongest at most.
    Weights are log-odds."""

    def rows(batch):
        data, offs = arrow_bytes(batch.column("text"))
        label, part = np.asarray(batch.column("label")), np.asarray(batch.column("part"))
        cuts, of = segments(data, offs, hard=True)
        for i, j in row_steps(cuts):
            piece, own = data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]
            start, end, first = spans_of(_WORDY[piece], own)
            hashes = span_hashes(_LOWER[piece], start, end)
            for k in range(j - i):
                words, r = np.unique(hashes[first[k] : first[k + 1]]), of[i + k]
                yield pa.RecordBatch.from_pydict({"doc": pa.array(np.full(len(words), r, np.int32)), "word": pa.array(words.view(np.int64)), "label": pa.array(np.full(len(words), label[r], np.int32)), "part": pa.array(np.full(len(words), part[r], np.int32))})

    words = map_arrow(sample.where(F.col("part").isin(list(BOTH))), rows, "doc int, word long, label int, part int")
    half = F.col("part").isin(list(ONE))
    sums = [F.sum(F.when(test, value).otherwise(0)).alias(name) for name, test, value in (("a1", half, F.col("label")), ("b1", half, F.lit(1)), ("a2", ~half, F.col("label")), ("b2", ~half, F.lit(1)))]
    counts = stash(words.groupBy("word").agg(*sums).where(F.col("a1") + F.col("a2") >= LEAST_DOCS), "words", True)
    totals = sample.groupBy("part").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for group, a, b in ((ONE, F.col("a1"), F.col("b1")), (TWO, F.col("a2"), F.col("b2")), (BOTH, F.col("a1") + F.col("a2"), F.col("b1") + F.col("b2"))):
        ones, n = sum(r["ones"] for r in totals if r["part"] in group), sum(r["n"] for r in totals if r["part"] in group)
        odds = F.log((a + 0.5) / (ones + 1.0)) - F.log((b - a + 0.5) / (n - ones + 1.0))
        best = counts.where(a >= (LEAST_DOCS if group == BOTH else LEAST_DOCS // 2)).withColumn("w", odds).where(F.col("w") > 1.5).orderBy(F.desc(F.col("w") * F.sqrt(a)), "word").limit(LEARNED).collect()
        found = sorted((np.uint64(r["word"] & 0xFFFFFFFFFFFFFFFF), r["w"]) for r in best)
        out[group] = np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.float64)
    release(counts)
    return out


def _scores(column, model: dict) -> np.ndarray:
    x = features(*arrow_bytes(column), model["learned"], model["weights"])
    return np.clip(calibrated(model, raw_scores(model, x)), 0, 1)


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def rows(batch):
        s = _scores(batch.column("text"), model)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return map_arrow(docs.select("doc_id", text_or_empty().alias("text")), rows, "doc_id long, score double, predicted int")


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of ``docs``, learned from the rows of ``labels`` in use."""
    known = labels.where(fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, train(docs, known))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(read_documents(spark, sf_dir), read_labels(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all columns.  A
    score depends on the text alone, so each row is judged where it is: rows
    that repeat a doc_id, or have none, are judged each by their own text."""
    model = train(docs, labels.where(fold(4) != 2).select("doc_id", F.col("toxic").alias("label")))
    at = docs.columns.index("text")

    def rows(batch):
        yield batch.filter(pa.array(_scores(batch.column(at).cast(pa.string()), model) < threshold))

    return map_arrow(docs, rows, docs.schema)
