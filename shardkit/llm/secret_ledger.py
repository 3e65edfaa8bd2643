"""Secrets in texts, found once per content: an incremental ledger of blobs.

A blob is a text, addressed by its SHA-256. The ledger is a folder of Parquet batches with a row for
each blob and rule version that was scanned, and the spans found. A scan dedupes the
texts at hand by address, leaves out what the ledger has for this rule version, scans the rest
and adds it as one batch; findings are then joined back to every row ("path") that
holds the blob, in whichever version of the corpus: the ledger also keeps which path held which blob in which
version. Rules that change get another version, and old findings stay beside the new. Of a corpus that the ledger
knows already only addresses are compared: no text is shuffled.

Defined results: a null text is the empty text, without findings. Repeated rows and copies get
the findings of their blob each. Spans of different kinds may overlap; they are ordered by
start, then kind. An empty table adds nothing. Columns besides doc_id and text are left
out, but for redact(), which keeps all.
"""

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.session import settle
from shardkit.sources.commits import names
from shardkit.sources.layout import exists

MASK = "[SECRET]"
# Kinds in order, their patterns, the group that is measured and its least length.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
_PATHS = "doc_id bigint, corpus_version string"
_LEDGER = "blob binary, rule_version string, spans array<struct<kind: string, start: int, end: int>>"


def version_of(rules) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def compiled(rules):
    """Patterns to run. A pattern of one class that must be long is run with that length, which finds the same spans."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        if group == 0 and (one := re.fullmatch(r"(\w*)(\[[^\]]*\])\+", pattern)):
            # a run is matched whole, so only whole runs of the least length can pass
            pattern = f"{one[1]}{one[2]}{{{least - len(one[1])},}}"
        out.append((rank, kind, re.compile(pattern, re.ASCII), group, least))
    return out


def find(text: str, patterns) -> list[dict]:
    found = []
    for rank, kind, pattern, group, least in patterns:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [{"kind": kind, "start": start, "end": end} for start, _, kind, end in sorted(found)]


class SecretLedger:
    """The ledger at `root`, for one set of rules. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, rules=RULES):
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        self.version = version_of(rules)

    def _batches(self, kind: str = "batch") -> list[str]:
        """Batches that were written whole."""
        found = [f"{self.root}/{name}" for name in names(self.spark, self.root) if name.startswith(f"{kind}-")]
        return [path for path in found if exists(self.spark, f"{path}/_SUCCESS")]

    def scanned(self) -> DataFrame | None:
        """Blobs and spans of this rule version; None while there are none."""
        batches = self._batches()
        if not batches:
            return None
        return self.spark.read.schema(_LEDGER).parquet(*batches).where(F.col("rule_version") == self.version)

    @staticmethod
    def _addressed(docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        return docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"),
            text.alias("text"),
        )

    def _unseen(self, docs: DataFrame) -> DataFrame:
        """(blob, text) of texts that this rule version has not seen, each once."""
        rows = self._addressed(docs)
        if (scanned := self.scanned()) is not None:
            # addresses first: only texts that are new are brought together
            new = settle(rows.select("blob").distinct().join(scanned.select("blob"), "blob", "left_anti"))
            rows = rows.join(broadcast_within(new), "blob", "left_semi")
        # copies meet in the map side of the aggregation already, so none of them makes a task large
        return rows.groupBy("blob").agg(F.first("text").alias("text"))

    def update(self, docs: DataFrame, corpus_version: str | None = None) -> None:
        """Scans the blobs of docs that this rule version has not seen, and adds them.

        With `corpus_version`, the ledger also keeps which doc_id held which blob in that version; see history().
        """
        if corpus_version is not None:
            paths = self._addressed(docs).select("doc_id", "blob", F.lit(corpus_version).alias("corpus_version"))
            paths.write.parquet(f"{self.root}/paths-{uuid.uuid4().hex}")
        unseen = self._unseen(docs)
        rules, version = self.rules, self.version

        def scan(batches):
            patterns = compiled(rules)
            for batch in batches:
                spans = [find(t, patterns) for t in batch.column(1).to_pylist()]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([version] * len(spans), pa.string()), pa.array(spans, type=kind)],
                    names=["blob", "rule_version", "spans"],
                )

        unseen.mapInArrow(scan, _LEDGER).write.parquet(f"{self.root}/batch-{uuid.uuid4().hex}")

    def history(self) -> DataFrame:
        """doc_id, corpus_version, blob and spans of every path and version that the ledger keeps and this rule version has seen."""
        kept = self._batches("paths")
        if not kept or (scanned := self.scanned()) is None:
            return self.spark.createDataFrame([], f"{_PATHS}, {_LEDGER}").drop("rule_version")
        paths = self.spark.read.schema(_PATHS + ", blob binary").parquet(*kept).distinct()
        return paths.join(scanned, "blob").select("doc_id", "corpus_version", "blob", "spans")

    def findings(self, docs: DataFrame) -> DataFrame:
        """doc_id, blob and spans of every row of docs, after update(docs)."""
        paths = self._addressed(docs).select("doc_id", "blob")
        return paths.join(self.scanned(), "blob").select("doc_id", "blob", "spans")

    def redact(self, docs: DataFrame, mask: str = MASK) -> DataFrame:
        """Rows of docs with all their columns, each found span in the text replaced by `mask`; n_chars follows.

        Overlapping spans are replaced as one. Texts without findings, and null ones, stay as they are.
        """
        hits = settle(self.scanned().where(F.size("spans") > 0).select("blob", "spans"))

        @F.pandas_udf("string")
        def masked(texts, starts, ends):
            import pandas as pd

            out = []
            for text, a, b in zip(texts, starts, ends):
                if text is not None and a is not None and len(a):
                    parts, at = [], 0
                    for start, end in zip(a, b):
                        if start >= at:
                            parts += [text[at:start], mask]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            return pd.Series(out, dtype=object)

        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
        joined = rows.join(broadcast_within(hits), "blob", "left")
        clean = masked(F.col("row.text").cast("string"), F.col("spans.start"), F.col("spans.end"))
        out = joined.select("row", clean.alias("text"))
        return out.select(*[replaced(c, "n_chars" in docs.columns) for c in docs.columns])


def replaced(column: str, counted: bool):
    """A column of `row`, or what a changed `text` makes of it."""
    if column == "text":
        return F.col("text")
    if column == "n_chars":
        return F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast("bigint").alias("n_chars")
    return F.col(f"row.`{column}`").alias(column)
