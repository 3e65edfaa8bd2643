"""Lines that repeat across documents, counted in levelled sorted runs of line hashes.

A run holds, sorted by line hash, how many documents have a line and the largest id
among them. Documents come in batches of falling id, so the first run with a line knows the document that
keeps it, and a line that reached the least number of documents in some run needs no
further counting: each new batch merge-anti-joins the runs' finished lines and adds what is left as its
own run on level 0. A level with `fanout` runs is compacted into one run of the next
level, where counts add up. At the end all levels, of which there are few, are merged.

Defined results: a null or empty text is one empty line, which is kept. Rows with equal doc_id
count as one document, and a kept line stays in all of them, as often as it occurs; rows
with a null doc_id count as one document with the smallest id. Lines whose key is
shorter than the least length are never dropped. If all lines go, the text is empty. Only `\\n` ends a line.
drop_lines() keeps all columns of docs.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.llm.common import scratch, scratch_removed, stored
from shardkit.llm.secret_ledger import replaced
from shardkit.session import settle
from shardkit.sources.commits import CommitLog, delete

LEAST_CHARS = 40
LEAST_DOCS = 5
BATCHES = 4
FANOUT = 2
# What is stripped from a line, and the letters that lose their case.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def line_key(line):
    """A line's key as a column."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


_RUN = "line binary, n_docs bigint, last_doc bigint"


class LineRuns:
    """Runs (line, n_docs, last_doc) below `root`, by level; opened again, it goes on with the runs that are there.

    Which runs count is one small file per version, so that a compaction takes effect at once; the runs it replaced are then removed.
    """

    def __init__(self, spark: SparkSession, root: str, least_docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.root, self.least_docs, self.fanout = spark, root, least_docs, fanout
        self.log = CommitLog(spark, f"{root}/versions")

    @property
    def levels(self) -> list[list[str]]:
        """Names of the runs of each level."""
        return self.log.head()[1].get("levels", [])

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(f"{self.root}/runs/{name}")

    def runs(self) -> list[DataFrame]:
        return [self._run(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame, level: int, replaced: list[str]) -> None:
        name = f"{level}-{uuid.uuid4().hex}"
        run.sortWithinPartitions("line").write.parquet(f"{self.root}/runs/{name}")

        def change(_: int, content: dict) -> dict:
            levels = [[n for n in names if n not in replaced] for names in content.get("levels", [])]
            levels += [[] for _ in range(level + 1 - len(levels))]
            levels[level].append(name)
            return {"levels": levels}

        self.log.commit(change)
        for old in replaced:
            delete(self.spark, f"{self.root}/runs/{old}")
        full = self.levels[level]
        if len(full) >= self.fanout:
            self._write(self._merged([self._run(n) for n in full]), level + 1, full)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, batch: DataFrame) -> None:
        """batch: (line, doc_id) with ids below those of all earlier batches."""
        own = batch.distinct().groupBy("line").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")
        )
        for run in self.runs():
            done = run.where(F.col("n_docs") >= self.least_docs).select("line")
            own = own.join(done.hint("merge"), "line", "left_anti")
        self._write(own, 0, [])

    def repeated(self) -> DataFrame:
        """(line, last_doc) of lines in at least `least_docs` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "line binary, last_doc bigint")
        return self._merged(self.runs()).where(F.col("n_docs") >= self.least_docs).select("line", "last_doc")


def _document():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID))


def batch_of(low: int, high: int, batches: int):
    """Number of the batch of doc_id, from 0 to batches - 1: how many of the batches' upper ends are not below it.

    The ends are whole numbers, so each id is in one batch. Ids below `low` (null ones) are in the last.
    """
    width = max(1, -(-(high - low + 1) // batches))
    ends = [max(high - n * width, _NO_ID) for n in range(1, batches)]
    return sum((F.when(F.col("doc_id") <= F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))


def drops(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """(document, lines): hashes of the lines that each document loses."""
    spark = docs.sparkSession
    low, high = docs.agg(F.min(F.col("doc_id").cast("bigint")), F.max(_document())).first()
    if high is None:
        return spark.createDataFrame([], "document bigint, lines array<binary>")
    batch = batch_of(high if low is None else low, high, batches)
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    long = F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= least_chars)
    hashes = F.array_distinct(F.transform(long, lambda k: F.unhex(F.md5(k.cast("binary")))))
    with scratch_removed(spark) as result:
        hashed = docs.select(_document().alias("doc_id"), F.explode(hashes).alias("line"))
        hashed = stored(hashed.withColumn("batch", batch), "line-hashes")
        runs = LineRuns(spark, scratch(spark, "line-runs"), least_docs, fanout)
        for number in range(batches):
            runs.add(hashed.where(F.col("batch") == number).select("line", "doc_id"))
        repeated = settle(runs.repeated())
        lost = hashed.join(broadcast_within(repeated), "line").where(F.col("doc_id") != F.col("last_doc"))
        # of all hashes and runs, only what documents lose is needed further on
        return result(lost.groupBy(F.col("doc_id").alias("document")).agg(F.collect_set("line").alias("lines")), "lost-lines")


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, **options) -> DataFrame:
    """Rows of docs as `row`, the text that is left as `text`, n_lines (before) and n_dropped.

    What documents lose is joined to them; one that loses nothing passes as it is. Texts are brought to what they lose
    however little that is: a broadcast of it would end at some size, and the disk needed would rise there at once.
    """
    lost = drops(docs, least_chars, **options)
    rows = docs.select(F.struct("*").alias("row"), _document().alias("document"))

    @F.pandas_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def rest(texts, lost_lines):
        import hashlib

        import pandas as pd

        lower = str.maketrans(UPPER, LOWER)
        kept, n_lines, n_dropped = [], [], []
        for text, lost in zip(texts, lost_lines):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if lost is not None and len(lost):
                lost = {bytes(x) for x in lost}
                left = []
                for line in lines:
                    key = line.strip(STRIPPED).translate(lower)
                    if len(key) < least_chars or hashlib.md5(key.encode("utf-8", "surrogatepass")).digest() not in lost:
                        left.append(line)
                n_dropped.append(len(lines) - len(left))
                text = "\n".join(left)
            else:
                n_dropped.append(0)
            kept.append(text)
        return pd.DataFrame({"text": kept, "n_lines": n_lines, "n_dropped": n_dropped})

    joined = rows.join(lost.hint("merge"), "document", "left")
    return joined.select("row", rest(F.col("row.text").cast("string"), "lines").alias("rest")).select("row", "rest.*")


def deduped(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs with all their columns, without the lines they lose; n_chars follows."""
    out = drop_lines(docs, **options)
    return out.select(*[replaced(c, "n_chars" in docs.columns) for c in docs.columns])
