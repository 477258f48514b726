"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Lengths are whole numbers from 1 to the sequence length, so pieces of one length are interchangeable
and the whole corpus is described by one count per length. Best-fit decreasing runs exactly on those
counts: a segment tree over remaining capacities finds the tightest open bin, and equal pieces are
placed in runs. What the driver holds is bounded by the sequence length, not by the corpus. Spark then
hands every piece the place that its rank within its length has.

Null text is empty; an empty text still has its end id. Null or repeated ids are packed like others.
An empty table gives an empty result. Further input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import arrow_rows, tidy, written
from pulsegrid.llm.tokens import REMEMBERED, encoder, tokenizer_path

SEQUENCE = 2048
END_ID = 0
#: Texts in one Arrow batch handed to a worker, and pieces in one handed back to Spark.
TEXTS, BATCH = 500, 20_000


class TightestBin:
    """Segment tree over remaining capacities 0 to ``capacity``; a leaf tells whether such bins are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        node = remaining + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def find(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least`` that an open bin has."""
        node = least + self.size
        if self.open[node]:
            return least
        while node > 1 and (node % 2 or not self.open[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` (length to number of pieces).

    Returns runs (length, first rank, pieces, first bin, offset): the piece of that length with rank
    ``first rank + k`` goes to bin ``first bin + k`` at ``offset``. Equal pieces fill the tightest bin
    as long as they fit, since it then stays the tightest; so bins alike are filled alike.
    """
    tree, bins, runs, next_bin = TightestBin(capacity), {}, [], 0

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            bins.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.find(length)
            if remaining is None:
                remaining, first, n = capacity, next_bin, -(-left // (capacity // length))
                next_bin += n
            else:
                first, n = bins[remaining].pop()
                if not bins[remaining]:
                    tree.set(remaining, False)
            each = remaining // length
            full = min(n, left // each)
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, capacity - remaining + k * length))
                rank += full
            left -= full * each
            leave(remaining - each * length, first, full)
            if full < n and left < each:
                for k in range(left):
                    runs.append((length, rank, 1, first + full, capacity - remaining + k * length))
                    rank += 1
                leave(remaining - left * length, first + full, int(left > 0))
                unused = int(left > 0)
                left = 0
                leave(remaining, first + full + unused, n - full - unused)
    return runs


def cut(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; all but the first are full."""
    start, length = 0, (n - 1) % most + 1
    while start < n:
        yield start, length
        start, length = start + length, most


def pieces(documents: DataFrame, path: str, most: int = SEQUENCE, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, part and rank within part and length.

    ``keep_ids`` adds the ids themselves (little-endian unsigned 32-bit). Written, since ``part`` and
    ``rank`` belong to this one run.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
    schema = pa.schema(list(zip(names, kinds)))
    end = np.uint32(END_ID).tobytes()

    def run(batches):
        encode, part, ranks, rows = encoder(path, remembered), TaskContext.get().partitionId(), [0] * (most + 1), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id.as_py(), k, start, length, zlib.crc32(own), part, ranks[length], *([own] * keep_ids)))
                    ranks[length] += 1
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * keep_ids
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with arrow_rows(documents.sparkSession, TEXTS):
        return written(texts.mapInArrow(tidy(run, "tokens"), ddl), "pieces")


def pack(cut_pieces: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of part and rank."""
    per_part = cut_pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(best_fit_runs(counts, capacity), dtype=np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    length, first_rank, _, first_bin, offset = runs.T
    # ranks of one length stay below the number of its pieces, so this key keeps (length, rank) in order
    width = max(counts.values(), default=0) + 1
    keys = length * width + first_rank
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut_pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.drop("before", "part")
    names = [c for c in cut_pieces.columns if c not in ("part", "rank")]

    def place(batches):
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, own * width + rank, side="right") - 1
            places = [pa.array(first_bin[k] + rank - first_rank[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + places, names=[*names, "sequence_id", "offset"])

    kinds = dict(cut_pieces.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces that kept their ids: sequence_id, n_ids, ids. A group is at most one sequence long."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), ids.alias("ids"))


def pack_documents(
    documents: DataFrame, path: str | None = None, capacity: int = SEQUENCE, keep_ids: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """Every document's pieces and their places. ``remembered`` bounds the pre-tokens a worker keeps, at some 300 bytes each."""
    return pack(pieces(documents, path or tokenizer_path(), capacity, keep_ids, remembered), capacity)
