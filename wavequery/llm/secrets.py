"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content (the
blob).  The ledger is a table in the shared folder with one row per (blob, rule
version) already scanned: the spans found, empty lists included.  A scan takes
only the pairs that the ledger lacks, one copy of each blob, and appends them;
findings are read from the ledger and joined back to all paths.  A scan that is
cut off has appended nothing, and one that is repeated scans nothing.

Kinds of the base rules, leftmost and non-overlapping within a kind: ``assign``
(a keyword, a separator and a value of 6 or more characters), ``access`` (20 or
more characters) and ``hex`` (24 or more).  Further kinds only add spans.

Edge cases: null text counts as empty; an empty text is a blob without
findings; rows that repeat a doc_id are versions of one path, rows that repeat a
text paths of one blob, rows without a doc_id paths without a name, and each
gets its findings; very long texts are searched whole, in time and memory
proportional to them; an empty table gives an empty result; other columns,
whatever their names, are ignored.  Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, keep_ids, map_arrow, read_documents, release, shared_dir, split_join, stash, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULE_VERSION = "2024-2"

#: kind, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
BASE = ("assign", "access", "hex")

#: The setting that names a lasting ledger for ``op3_secret_scan``; without it a
#: run has a ledger of its own.
LEDGER_SETTING = "spark.wavequery.secrets.ledger"

#: ``scan`` names the run that scanned a blob.
LEDGER = "blob string, rule_version string, scan string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str, rules=RULES) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, kind) of all findings, in order."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def _join(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def _scan(version: str, rules, name: str):
    compiled = tuple((kind, re.compile(pattern), group, least) for kind, pattern, group, least in rules)

    def scan(batch: pa.RecordBatch):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text").to_pylist():
            spans = find_spans(text, compiled)
            base = [x for x in spans if x[3] in BASE]
            for kind in BASE:
                out[f"n_{kind}"].append(sum(x[3] == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
            out["spans"].append(_join(spans))
        columns = {"blob": batch.column("blob"), "rule_version": pa.array([version] * batch.num_rows, pa.string()), "scan": pa.array([name] * batch.num_rows, pa.string())}
        yield pa.RecordBatch.from_pydict(columns | {k: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for k, v in out.items()})

    return scan


class Ledger:
    """The ledger in the folder ``path``; a new one of its own in the shared
    folder if that is not given."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.name = uuid.uuid4().hex
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"
        spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(self.path)

    def rows(self, version: str) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path).where(F.col("rule_version") == version)

    def lacks(self, paths: DataFrame, version: str) -> DataFrame:
        """One path, (doc_id, blob), of every blob that wasn't scanned by the rules."""
        blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        return blobs.join(self.rows(version).select("blob"), "blob", "left_anti").select("doc_id", "blob")

    def scan(self, docs: DataFrame, version: str = RULE_VERSION, rules=RULES) -> tuple[DataFrame, int]:
        """Scan what the ledger lacks and append it.  Returns (doc_id, blob) of
        every row of ``docs`` and how many blobs were scanned."""
        blob = F.sha2(text_or_empty().cast("binary"), 256)
        paths = stash(docs.select("doc_id", blob.alias("blob")), "paths")
        unseen = stash(self.lacks(paths, version), "unseen", True)
        n = unseen.count()
        if n:
            texts = docs.select("doc_id", text_or_empty().alias("text"), blob.alias("blob"))
            others = stash(paths.distinct().join(unseen, (paths["blob"] == unseen["blob"]) & paths["doc_id"].eqNullSafe(unseen["doc_id"]), "left_anti"), "others", True)
            # By the shorter list: of what to scan, or of what not to.
            short = [F.col("doc_id"), _name("blob").alias("name")]
            named = texts.withColumn("name", _name("blob"))
            named = drop_ids(named, others.select(short), ["doc_id", "name"]) if others.count() < n else keep_ids(named, unseen.select(short), ["doc_id", "name"])
            fresh = stash(map_arrow(named.select("text", "blob"), _scan(version, rules, self.name), LEDGER), "findings")
            fresh.dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
            release(others, fresh)
        release(unseen)
        return paths, n

    def findings(self, paths: DataFrame, version: str = RULE_VERSION) -> DataFrame:
        """The ledger's columns for every path; blobs that very many paths share
        meet them on the map side."""
        return split_join(paths, self.rows(version), "blob")


def _name(blob: str):
    """60 bits of a blob: with the doc_id, they name a version in 16 bytes."""
    return F.conv(F.substring(blob, 1, 15), 16, 10).cast("long")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document by way of the ledger that the setting names: a
    run scans what earlier ones haven't.  ``new_blob``: this run scanned it."""
    ledger = Ledger(spark, spark.conf.get(LEDGER_SETTING, None))
    paths, _ = ledger.scan(read_documents(spark, sf_dir))
    found = ledger.findings(paths).withColumn("new_blob", F.col("scan") == ledger.name)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob", "rule_version", "new_blob")
