"""Exact deduplication with counting quotient filters and byte verification.

Texts are compared after lower-casing A-Z only. Every part of the corpus builds a counting quotient
filter of its texts' fingerprints: a fingerprint's high bits name a slot, its low bits are the
remainder kept there, remainders of a slot stay sorted, each with a count. Filters merge without loss
by merging sorted remainders and adding counts. Slots are cut into ranges, so that the merge of each
range is a task of its own and no task holds the whole filter. Texts whose fingerprint has a count of
one are unique; the others are compared byte by byte.

Null counts as the empty text. Of equal texts the row with the largest doc_id stays; null is below all.
Of rows that repeat both doc_id and text one stays, the first as read. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import partitions, text_bytes, tidy, written

#: Bits of a fingerprint, and of its remainder; the rest is the slot.
FINGERPRINT, REMAINDER = 52, 28


class CountingQuotientFilter:
    """Slots with sorted remainders and counts, for slots ``first`` up to ``last``.

    ``runs[q]`` to ``runs[q + 1]`` are the places of slot ``first + q``. ``to_bytes`` writes the slots in
    use as gaps, remainders in 32 bits, and counts only where they are above one.
    """

    def __init__(self, slots: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.slots, self.remainders, self.counts = slots, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        unique, counts = np.unique(fingerprints, return_counts=True)
        return cls(unique >> REMAINDER, (unique & ((1 << REMAINDER) - 1)).astype(np.uint32), counts.astype(np.int64))

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        slots = np.concatenate([self.slots, other.slots])
        remainders = np.concatenate([self.remainders, other.remainders])
        counts = np.concatenate([self.counts, other.counts])
        order = np.lexsort((remainders, slots))
        slots, remainders, counts = slots[order], remainders[order], counts[order]
        first = np.flatnonzero((np.diff(slots, prepend=-1) != 0) | (np.diff(remainders.astype(np.int64), prepend=-1) != 0))
        return CountingQuotientFilter(slots[first], remainders[first], np.add.reduceat(counts, first) if len(first) else counts)

    def repeated(self) -> np.ndarray:
        """Fingerprints with a count above one."""
        own = self.counts > 1
        return self.slots[own] << REMAINDER | self.remainders[own].astype(np.int64)

    def ranges(self, n: int):
        """The filter cut into ``n`` ranges of slots: (range, filter), empty ones left out."""
        edges = np.searchsorted(self.slots, [(k << (FINGERPRINT - REMAINDER)) // n for k in range(n + 1)])
        for k in range(n):
            a, b = edges[k], edges[k + 1]
            if a < b:
                yield k, CountingQuotientFilter(self.slots[a:b], self.remainders[a:b], self.counts[a:b])

    def to_bytes(self) -> bytes:
        many = np.flatnonzero(self.counts > 1)
        head = np.array([len(self.slots), len(many), self.slots[0] if len(self.slots) else 0], "<i8").tobytes()
        gaps = np.diff(self.slots, prepend=self.slots[:1]).astype("<u4").tobytes()
        return head + gaps + self.remainders.astype("<u4").tobytes() + many.astype("<u4").tobytes() + self.counts[many].astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        n, n_many, first = np.frombuffer(data, "<i8", 3)
        at = 24
        slots = first + np.cumsum(np.frombuffer(data, "<u4", n, at).astype(np.int64))
        remainders = np.frombuffer(data, "<u4", n, at + 4 * n)
        many = np.frombuffer(data, "<u4", n_many, at + 8 * n)
        counts = np.ones(n, np.int64)
        counts[many] = np.frombuffer(data, "<i8", n_many, at + 8 * n + 4 * n_many)
        return cls(slots, remainders, counts)


def normal(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> (64 - FINGERPRINT)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and SHA-256 of every row's normal text, and the row's number; written."""

    def run(batches):
        for batch in batches:
            texts = [normal(t) for t in text_bytes(batch.column(1))]
            prints = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "print", "sha"])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(source.mapInArrow(tidy(run), "doc_id long, print long, sha binary").withColumn("row", F.monotonically_increasing_id()), "signed")


def repeated_prints(prints: DataFrame, ranges: int) -> DataFrame:
    """Fingerprints (column ``print``) that occur more than once, by filters per part merged per range of slots."""

    def build(batches):
        whole = CountingQuotientFilter.of(np.empty(0, np.int64))
        for batch in batches:
            whole = whole.merged(CountingQuotientFilter.of(batch.column(0).to_numpy()))
        parts = list(whole.ranges(ranges))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([f.to_bytes() for _, f in parts], pa.binary())], names=["range", "filter"])

    def merge(batches):
        at, whole = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = CountingQuotientFilter.from_bytes(data.as_py())
                if k != at and at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(whole.repeated())], names=["print"])
                at, whole = k, own if k != at else whole.merged(own)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(whole.repeated())], names=["print"])

    filters = prints.mapInArrow(tidy(build), "range int, filter binary")
    return filters.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "print long")


def verified_groups(documents: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of the texts with a repeated fingerprint, compared as bytes: sha, keep_id and group_size of each distinct one."""

    def run(batches):
        for batch in batches:
            texts = [normal(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "print", "bytes"])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = source.mapInArrow(tidy(run), "doc_id long, print long, bytes binary").join(repeated, "print", "left_semi")
    groups = texts.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return groups.select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "keep_id", "group_size")


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = signed(documents)
    repeated = written(repeated_prints(rows.select("print"), partitions(documents.sparkSession)), "prints")
    groups = written(verified_groups(documents, repeated), "copies")
    single = F.col("group_size").isNull()
    # of rows that repeat the doc_id that stays, the first stays
    first = rows.groupBy("sha", "doc_id").agg(F.min("row").alias("keep_row")).alias("f")
    same = (F.col("f.sha") == F.col("g.sha")) & F.col("f.doc_id").eqNullSafe(F.col("g.keep_id"))
    out = rows.join(groups.alias("g").join(first, same).select("g.*", "keep_row"), "sha", "left")
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of equal texts, all columns kept.

    Rows with a fingerprint of their own pass; the others meet by their bytes and leave one whole row.
    """
    print_of = F.arrow_udf(lambda texts: pa.array([fingerprint(normal(t)) for t in text_bytes(texts)], pa.int64()), "long")
    bytes_of = F.arrow_udf(lambda texts: pa.array([normal(t) for t in text_bytes(texts)], pa.binary()), "binary")
    prints = documents.select(print_of("text").alias("print"))
    repeated = written(repeated_prints(prints, partitions(documents.sparkSession)), "prints")
    marked = documents.withColumn("_print", print_of("text"))
    single = marked.join(repeated, marked["_print"] == repeated["print"], "left_anti").drop("_print")
    shared = marked.join(repeated, marked["_print"] == repeated["print"], "left_semi").drop("_print")
    row, order = F.struct(*documents.columns), F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    last = shared.groupBy(bytes_of("text").alias("_bytes")).agg(F.max_by(row, order).alias("_row"))
    return single.unionByName(last.select("_row.*"))
