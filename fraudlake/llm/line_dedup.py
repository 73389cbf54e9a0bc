"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` is the index: a run is a table of (h1, h2, docs, owner) - a
128-bit line hash, the number of documents that hold the line and the largest
id among them - bucketed and sorted by hash. A batch of documents is
aggregated to that form, merge-anti-joined with every run (both sides are
bucketed alike, so only the batch is shuffled) to leave out the lines whose
fate the runs have settled, and added as a run of level 0. When a level holds
``fanout`` runs they are merged into one run of the next level.

Lines are then looked up against the merged index and the ones that repeat
are cut out of the texts. The text is read for hashing once and shuffled once,
by document, for the cut; hot lines are one row per run in the index, and the
lookup is a plain sort-merge join that adaptive execution can split.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.llm.common import (SPACE, at_most_count, id_bounds, let, lower_ascii, set_aside,
                                  shuffle_partitions, written)
from fraudlake.session import scratch_path

HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long, owner long"


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    return let(F.btrim(line, F.lit(SPACE)), lower_ascii)


def _hash(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per document: ``row_hash`` of the text, ``lines`` (position and hash of every
    line long enough) and ``distinct`` (the hashes without repeats)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(F.split(text, "\n"), line_key)
    base = docs.select("id", F.xxhash64(text).alias("row_hash"), keys.alias("keys"))
    long_enough = lambda k: F.char_length(k) >= min_chars                     # noqa: E731
    numbered = F.filter(F.transform(F.col("keys"), lambda k, i: F.struct(
        i.alias("pos"), F.when(long_enough(k), F.xxhash64(k)).alias("h1"),
        F.when(long_enough(k), F.xxhash64(F.lit(1), k)).alias("h2"))), lambda s: s["h1"].isNotNull())
    distinct = F.transform(F.array_distinct(F.filter(F.col("keys"), long_enough)),
                           lambda k: F.struct(*_hash(k)))
    return base.select("id", "row_hash", numbered.alias("lines"), distinct.alias("distinct"))


@dataclass
class LineRuns:
    """The levelled run index of one corpus, kept under the shared scratch folder
    (or ``root``). ``min_docs`` documents settle a line."""

    spark: SparkSession
    min_docs: int = 3
    fanout: int = 4
    root: str | None = None
    buckets: int | None = None
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = self.root or scratch_path(self.spark, "line-runs")
        self.buckets = self.buckets or shuffle_partitions(self.spark)

    def _write(self, entries: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex[:16]}"
        entries.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH) \
            .sortBy(*HASH).option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        # read by path: a union of bucketed scans must not pass for hash-partitioned
        whole = self.spark.read.schema(RUN).parquet(*[f"{self.root}/{n}" for n in names])
        return whole.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (id, distinct) rows, largest ids first for best effect;
        any order gives the same index answers."""
        entries = batch.select("id", F.explode("distinct").alias("h")) \
            .select("h.h1", "h.h2", F.coalesce("id", F.lit(-2 ** 63)).alias("id")) \
            .groupBy(*HASH).agg(F.count("*").alias("docs"), F.max("id").alias("owner"))
        for name in self.runs():
            # settled: already frequent, and no document of this batch can become its owner
            run = self.spark.table(name).where(F.col("docs") >= self.min_docs)
            known = run.select(*HASH, F.col("owner").alias("_owner"))
            cond = [entries[c] == known[c] for c in HASH] + [known["_owner"] >= entries["owner"]]
            entries = entries.join(known, cond, "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(entries))
        self._compact()

    def _compact(self) -> None:
        depth = 0
        while depth < len(self.levels) and len(self.levels[depth]) >= self.fanout:
            merged = self._write(self._merged(self.levels[depth]))
            for name in self.levels[depth]:
                self.spark.sql(f"drop table if exists {name}")
            self.levels[depth] = []
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(merged)
            depth += 1

    def forget(self) -> None:
        """Drop the catalogue entries of the runs; their files stay in ``root``."""
        for name in self.runs():
            self.spark.sql(f"drop table if exists {name}")

    def frequent(self) -> DataFrame:
        """Hash and owner of every line held by at least ``min_docs`` documents."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        return self._merged(self.runs()).where(F.col("docs") >= self.min_docs).select(*HASH, "owner")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 5,
                fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text`` added.

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents goes from all of them but the one with the
    largest id. Lines are split at \\n only; other lines stay, joined by \\n.
    Null or empty text is one empty line. Every row counts as a document of its
    own; rows that share the largest id all keep the line, a null id is the
    smallest. An empty table gives no rows; other columns pass through, except
    ones named like an added column.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bounds = id_bounds(docs, id_col, batches)
    batch_no = F.coalesce(at_most_count(F.col("id"), bounds), F.lit(0))
    hashed = written(hashed_lines(plain, min_chars).withColumn("batch", batch_no),
                     "line-hashes", "batch")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(len(bounds), -1, -1):
        runs.add(hashed.where(F.col("batch") == b))
    frequent = written(runs.frequent(), "frequent-lines")
    runs.forget()

    each = hashed.select("id", "row_hash", F.explode("lines").alias("l")) \
        .select("id", "row_hash", "l.pos", "l.h1", "l.h2")
    drops = each.join(frequent, HASH).where(F.col("owner") != F.coalesce("id", F.lit(-2 ** 63))) \
        .groupBy(F.col("id").alias("_id"), F.col("row_hash").alias("_row_hash")) \
        .agg(F.collect_list("pos").alias("_drop"))
    drops = written(drops, "line-drops")
    own, back = set_aside(docs, [])
    mine = {c: f"_extra{i}" for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(mine[text_col]), F.lit(""))
    # texts meet their dropped lines by a merge join at every size; adaptive execution splits hot keys
    joined = own.withColumn("_h", F.xxhash64(text)).join(
        drops.hint("merge"), F.col(mine[id_col]).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_row_hash")), "left")
    n_lines = F.size(F.split(text, "\n"))
    keep = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_drop"))
    kept = let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    out = joined.select(
        *mine.values(), n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct("_drop")))
        .cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), text).otherwise(kept).alias("kept_text"))
    return back(out, "n_lines", "n_dropped", "kept_text")
