"""Secret scan over an incremental blob ledger.

Every historical version of a file is a row (doc_id as path, text). Texts are content-addressed by
SHA-256; the ledger says which (blob, rule version) pairs have been scanned and what was found. A
run scans each unseen blob once, however many paths and versions share it, and joins findings back
to all paths. Rule versions are part of the key: new rules scan everything again, old findings stay.

Which row stands for a blob is settled on (blob, doc_id) alone, with partial aggregation, so a blob
shared by a third of all rows is one row before anything is sent; texts are sent once, to be spread
over all tasks, and only for unseen blobs kept. The join back to paths carries no text.

Null text counts as empty and is a blob like any other; doc_id null is a path like any other;
repeated rows each get the blob's findings. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, joined, shared_folder, written

#: Kinds in the order of the contract, then the ones of this library.
KINDS = ("assign", "access", "hex", "pem", "forge", "chat", "jwt", "url")
RULE_VERSION = "2026-1"

#: The patterns of the contract. Keyword letters count in either case, ASCII only.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 and more are those of the contract's `[0-9a-f]+` that pass its length test.
_HEX = re.compile(r"[0-9a-f]{32,}+")

#: Further rules: kind, string that must be there, pattern.
_MORE = (
    ("pem", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?")),
    ("forge", "_", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+)")),
    ("forge", "glpat-", re.compile(r"(?<![A-Za-z0-9_-])glpat-[A-Za-z0-9_-]{20,}+")),
    ("chat", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{16,}+")),
    ("url", "://", re.compile(r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}+:[^\s:/@]{6,128}+@")),
)
_KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_HEX_SAMPLE = re.compile(r"[0-9a-f]{8}")


def find_spans(text: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """Base spans and further spans of a text as (start, rank of kind, kind, end)."""
    base: list[tuple[int, int, str, int]] = []
    if _KEYWORDS.search(text):
        base += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        base += [
            (m.start(), 1, "access", m.end())
            for m in _ACCESS.finditer(text)
            if m.end() - m.start() >= 16
        ]
    # A run of 32 covers 8 places of every fourth character, so a quarter of the text tells.
    if _HEX_SAMPLE.search(text[::4]):
        base += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    more = [
        (m.start(), KINDS.index(kind), kind, m.end())
        for kind, gate, pattern in _MORE
        if gate in text
        for m in pattern.finditer(text)
    ]
    return base, more


def scan_text(text: str | None) -> dict:
    base, more = find_spans(text or "")
    count = lambda kind: sum(x[2] == kind for x in base)
    return {
        "n_assign": count("assign"),
        "n_access": count("access"),
        "n_hex": count("hex"),
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
        "spans": joined(base + more),
    }


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FINDINGS = f"blob binary, rule_version string, {_FOUND}"
_ARROW = pa.schema(
    [("blob", pa.binary()), ("rule_version", pa.string())]
    + [(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _FOUND.split(", "))]
)


def _scan(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            rows = (
                {"blob": b, "rule_version": version} | scan_text(t)
                for b, t in zip(blobs, texts, strict=True)
            )
            yield from batches_of(rows, _ARROW, 4096)

    return run


class BlobLedger:
    """Findings by blob and rule version, as Parquet folders that runs only add to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def findings(self) -> DataFrame:
        """All findings so far; empty before the first run."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return self.spark.createDataFrame([], FINDINGS)
        # A run that was repeated may have added a blob twice, with the same findings.
        return (
            self.spark.read.schema(FINDINGS)
            .parquet(self.path)
            .dropDuplicates(["blob", "rule_version"])
        )

    def add(self, findings: DataFrame) -> None:
        findings.write.mode("append").parquet(self.path)


def addressed(versions: DataFrame) -> DataFrame:
    """Paths with the blob their text is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select("doc_id", F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan_unseen(versions: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs the ledger does not have under these rules, and add them to it.
    Returns the paths (doc_id, blob)."""
    paths = written(addressed(versions).select("doc_id", "blob"), "secret-paths")
    seen = ledger.findings().where(F.col("rule_version") == rule_version).select("blob")
    todo = (
        paths.groupBy("blob")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(seen, "blob", "left_anti")
        .select(F.col("blob").alias("todo_blob"), F.col("doc_id").alias("todo_id"))
    )
    texts = addressed(versions)
    # The narrow side is built into a table per task; texts stream past it unsorted.
    unseen = texts.join(
        todo.hint("shuffle_hash"),
        (texts.blob == F.col("todo_blob")) & texts.doc_id.eqNullSafe(F.col("todo_id")),
    ).select("blob", "text")
    ledger.add(unseen.mapInArrow(_scan(rule_version), FINDINGS))
    return paths


def scan_secrets(
    versions: DataFrame, ledger: BlobLedger | None = None, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Findings of every path. Without a ledger, a new and empty one is used."""
    spark = versions.sparkSession
    ledger = ledger or BlobLedger(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    paths = scan_unseen(versions, ledger, rule_version)
    found = ledger.findings().where(F.col("rule_version") == rule_version)
    return paths.join(found, "blob").select(
        "doc_id",
        F.lower(F.hex("blob")).alias("blob"),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        "spans",
    )
