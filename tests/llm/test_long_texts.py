"""One text of 30 MB through what each operator does in a Python worker: the
process stays far below an executor's 3 GB."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

MADE = """
import random, resource, sys
import numpy as np, pyarrow as pa
from wavequery.llm import context_tree, filter_audit, ranked_search, jaccard_join, pieces, pii, quality, secrets, suffix_dedup, toxicity, winnowing, common

rng, kind = random.Random(1), sys.argv[2]
some = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)) for _ in range(40)]
size = int(sys.argv[3])
text = {"words": lambda: " ".join(rng.choice(some) for _ in range(size // 13_000)), "one letter": lambda: "x" * size, "no space": lambda: ("q7" * 4001 + "z") * (size // 8003)}[kind]()
batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "k": pa.array([2]), "d": pa.array([1]), "text": pa.array([text])})
bytes_of = lambda: common.arrow_bytes(batch.column("text"))


def op1():
    assert toxicity.features(*bytes_of(), np.zeros(0, np.uint64), np.zeros(0)).shape == (1, 15)


def op2():
    assert sum(b.num_rows for b in jaccard_join._nodes(3, 90)(batch)) == 1


def op3():
    secrets.find_spans(text)


def op4():
    assert sum(len(x) for x in suffix_dedup._runs(200, 24, False)(batch))


def op6():
    assert quality.grams(*bytes_of())[1][-1]


def op7():
    assert pii.replace(text, pii.Cipher(b"key"))[0]


def op8():
    assert len(winnowing.fingerprints([text])[1][0])


def op10():
    ids, _, exact = pieces.Pieces(pieces.load_model()).encode_all([text])
    assert exact.all()


def op11():
    assert len(filter_audit.text_masks(batch.column("text"))) == 1


def op12():
    assert sum(n.sum() for _, _, n in ranked_search.term_counts(batch.column("text"))) > 0


def op13():
    text, offs = context_tree.stream(*bytes_of())
    keys, counts = context_tree.counted(text, offs, np.array([True]))
    places = context_tree.Places(keys[keys < context_tree.WORD])
    assert sum(len(places.find(own)) for _, _, own in context_tree.runs(text, offs)) == len(text)


globals()[sys.argv[1]]()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("kind", ["words", "one letter", "no space"])
@pytest.mark.parametrize("operator", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op10", "op11", "op12", "op13"])
def test_memory(operator, kind):
    # Runs without a cut take some microseconds a character, so op10 gets fewer.
    size = 2_000_000 if operator == "op10" and kind != "words" else 30_000_000
    out = subprocess.run([sys.executable, "-c", MADE, operator, kind, str(size)], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout) < 2000
