"""Windows of token ids: best-fit decreasing with a segment tree over remaining capacities, then gaps filled exactly.

A document's ids are first cut into full windows; what is left over, shorter than a window, is a tail. Tails go,
longest first, into the open window with the least room that still holds them, which a segment tree indexed by
remaining capacity finds. Tails of one length are interchangeable, so the driver holds one count per length and runs
of equal windows, whatever the corpus, and Spark gives every tail the place of its rank within its length.

Windows that are not full would be padded. As pieces may be cut anywhere, some tails of at most ``SAND`` ids are held
back, as many as the gaps left by all others need, and are laid over the gaps one after the other, cut where a gap ends.
What then remains forms full windows, and a last rest of fewer ids than a window goes into windows whose sizes are powers of two,
which need no padding. So windows are padded only where the corpus has too few ids in short tails to fill the gaps.

Null text is empty; an empty text still has its end id. Texts are read whole, of any length. Null or repeated ids are
placed like others. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import KEPT, tidy, written
from pulsegrid.llm.tokens import byte_letters, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: The longest tail that may be cut to fill gaps; the ids of such tails are kept until then.
SAND = 256
#: Words remembered by one worker, none longer than this; others are encoded anew each time.
REMEMBERED, LONGEST = 300_000, 40
#: Rows, and bytes of kept ids, in one Arrow batch handed back to Spark.
BATCH, BATCH_BYTES = 20_000, 8 << 20


class WordEncoder:
    """Ids of a text by a tokenizer that lower-cases, drops white space and ends its words.

    Texts of printable ASCII, line ends, tabs and Latin-1 letters are cut into words here, and each distinct word goes once through the
    tokenizer's model; any other text, or one with a special token's string, goes whole through the library.
    """

    PLAIN = re.compile(r"[\x20-\x7e\n\r\tÀ-ÖØ-öø-ÿ]*\Z")
    WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
            if len(self.known) < REMEMBERED and len(word) <= LONGEST:
                self.known[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if self.PLAIN.match(text) is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode_batch([text], add_special_tokens=False)[0].ids).tobytes()
        words = self.WORDS.findall(text.lower())
        parts = [*map(self.known.get, words)]
        if None in parts:
            parts = [found if found is not None else self._word(w) for found, w in zip(parts, words)]
        return b"".join(parts)


_ENCODERS: dict[str, WordEncoder] = KEPT.setdefault("windows", {})


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; Python workers are reused, and so is what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Run(NamedTuple):
    """Tails of one length with ranks from ``rank``, ``n`` of them, one each in windows from ``window`` at ``offset``."""

    length: int
    rank: int
    n: int
    window: int
    offset: int


class Gap(NamedTuple):
    """``n`` windows from ``window`` with ``size`` places free from ``offset``."""

    size: int
    window: int
    n: int
    offset: int


class OpenWindows:
    """Runs of open windows by their remaining capacity, and a segment tree that tells which capacities there are."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _mark(self, room: int, value: int) -> None:
        node = room + self.leaves
        self.some[node] = value
        while node := node >> 1:
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def add(self, room: int, window: int, n: int) -> None:
        if n and room:
            self.runs[room].append((window, n))
            self._mark(room, 1)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(room, window, n) of a run with the least room of at least ``least``; it is open no longer."""
        node = least + self.leaves
        # up to the first node whose right neighbour's side has an open window, then down to its leftmost
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.some[2 * node])
        room = node - self.leaves
        window, n = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return room, window, n


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Run], list[Gap], int]:
    """Best-fit decreasing over ``counts`` (length to number of pieces): runs, gaps left, and number of windows.

    A window that took the tightest piece of a length stays the tightest while another fits, so it takes as many as
    fit before the next window does; windows of a run are treated alike.
    """
    open_windows, runs, windows = OpenWindows(capacity), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            found = open_windows.take(length)
            if found is None:
                n = -(-left // (capacity // length))
                found = capacity, windows, n
                windows += n
            room, window, n = found
            each = room // length
            full, rest = divmod(min(left, n * each), each)
            for some, first, inside in ((full, window, each), (1, window + full, rest)):
                for k in range(inside if some else 0):
                    runs.append(Run(length, rank, some, first, capacity - room + k * length))
                    rank += some
            open_windows.add(room - each * length, window, full)
            open_windows.add(room - rest * length, window + full, int(rest > 0))
            used = full + (rest > 0)
            open_windows.add(room, window + used, n - used)
            left -= full * each + rest
    gaps = [Gap(room, window, n, capacity - room) for room, held in sorted(open_windows.runs.items()) for window, n in held]
    return runs, gaps, windows


class Plan(NamedTuple):
    """Where every piece goes: ``runs`` for whole pieces; ``held`` (length to first rank held back) over ``gaps``."""

    runs: list[Run]
    held: dict[int, int]
    gaps: list[Gap]


def plan(counts: dict[int, int], capacity: int = WINDOW, sand: int = SAND) -> Plan:
    """Best fit with as few short tails held back as fill the gaps that the others leave."""
    need, total = 0, sum(k * n for k, n in counts.items() if k <= sand)
    while True:
        whole, held, taken = dict(counts), {}, 0
        for length in sorted((k for k in counts if k <= sand), reverse=True):
            n = min(counts[length], -(-max(need - taken, 0) // length))
            if n:
                held[length] = whole[length] = counts[length] - n
                taken += n * length
        runs, gaps, windows = best_fit({k: n for k, n in whole.items() if n}, capacity)
        # a window whose ids are a power of two in number is not padded
        gaps = [g for g in gaps if g.offset & (g.offset - 1)]
        room = sum(g.size * g.n for g in gaps)
        if room <= taken or taken == total:
            break
        need = min(total, max(2 * need, room))
    left = taken - room
    if left > 0:
        gaps.append(Gap(capacity, windows, left // capacity, 0))
        windows += left // capacity
        bits = [b for b in range(capacity.bit_length(), -1, -1) if left % capacity >> b & 1]
        gaps += [Gap(1 << b, windows + k, 1, 0) for k, b in enumerate(bits)]
    return Plan(runs, held, [g for g in gaps if g.n])


PIECE = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
RANKED = PIECE | {"part": pa.int32(), "rank": pa.int64(), "ids": pa.binary()}
PLACED = PIECE | {"sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()}
DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def ddl(columns: dict) -> str:
    return ", ".join(f"{name} {DDL[kind]}" for name, kind in columns.items())


def table_of(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), columns.values())], schema=pa.schema(list(columns.items())))


def pieces(documents: DataFrame, path: str, capacity: int = WINDOW, sand: int = SAND, keep_ids: bool = False) -> DataFrame:
    """One row per piece: full windows, and the tail with its ids if at most ``sand`` long (``keep_ids``: all ids).

    ``rank`` counts the pieces of one length within ``part``, the task that cut them; so the table is written.
    """
    end = np.uint32(END_ID).tobytes()

    def run(batches):
        encode = encoder(path)
        part, ranks, rows, held = TaskContext.get().partitionId(), [0] * (capacity + 1), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode.ids(text.as_py() or "") + end
                n, doc_id = len(ids) // 4, doc_id.as_py()
                for start in range(0, n, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    kept = own if keep_ids or length <= sand else None
                    rows.append((doc_id, start, length, zlib.crc32(own), n, part, ranks[length], kept))
                    ranks[length] += 1
                    held += len(kept or b"")
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield table_of(rows, RANKED)
                        rows, held = [], 0
        if rows:
            yield table_of(rows, RANKED)

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(texts.mapInArrow(tidy(run, "windows"), ddl(RANKED)), "window-pieces")


def place(cut: DataFrame, capacity: int = WINDOW, sand: int = SAND, keep_ids: bool = False) -> DataFrame:
    """``pieces`` in their windows: ``PLACED``; ``ids`` only with ``keep_ids``."""
    per_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan_ = plan(counts, capacity, sand)
    # runs and gaps by one rising key each: (length, rank) is below length * width + width
    width = max(counts.values(), default=0) + 1
    runs = np.array(plan_.runs, dtype=np.int64).reshape(-1, 5)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] * width + runs[:, 1]
    # held pieces lie one after the other on the axis on which the gaps lie
    held_at, at = {}, 0
    for length, first in plan_.held.items():
        held_at[length] = (first, at)
        at += (counts[length] - first) * length
    sizes = np.array([g.size * g.n for g in plan_.gaps], dtype=np.int64)
    gap_at = np.concatenate([[0], np.cumsum(sizes)])[: len(sizes)]
    gaps = plan_.gaps

    def cut_up(row: tuple, rank: int, ids: bytes):
        """A held piece over its gaps, which have room for all held pieces."""
        doc_id, start, length, _, n = row
        first, base = held_at[length]
        x, done = base + (rank - first) * length, 0
        while done < length:
            k = int(np.searchsorted(gap_at, x, side="right")) - 1
            gap = gaps[k]
            inside, into = divmod(x - int(gap_at[k]), gap.size)
            take = min(length - done, gap.size - into)
            own = ids[4 * done : 4 * (done + take)]
            yield doc_id, start + done, take, zlib.crc32(own), n, gap.window + inside, gap.offset + into, own if keep_ids else None
            x, done = x + take, done + take

    names = list(PIECE)

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            cut_too = np.array([n in held_at and r >= held_at[n][0] for n, r in zip(length.tolist(), rank.tolist())], dtype=bool)
            whole = batch.filter(pa.array(~cut_too))
            if whole.num_rows:
                own, rank_ = length[~cut_too], rank[~cut_too]
                k = np.searchsorted(keys, own * width + rank_, side="right") - 1
                columns = [whole.column(c) for c in names] + [pa.array(runs[k, 3] + rank_ - runs[k, 1]), pa.array(runs[k, 4])]
                columns.append(whole.column("ids") if keep_ids else pa.nulls(len(own), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(PLACED.items())))
            loose = batch.filter(pa.array(cut_too))
            if loose.num_rows:
                inputs = zip(*(loose.column(c).to_pylist() for c in [*names, "rank", "ids"]))
                yield table_of([piece for *row, r, ids in inputs for piece in cut_up(tuple(row), r, ids)], PLACED)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("rank")).select(*names, "rank", "ids")
    placed = ranked.mapInArrow(run, ddl(PLACED))
    return placed if keep_ids else placed.drop("ids")


def windows(documents: DataFrame, path: str | None = None, capacity: int = WINDOW, sand: int = SAND) -> DataFrame:
    """The windows themselves: sequence_id, n_ids, ids (little-endian unsigned 32-bit). A group is at most one window long."""
    placed = place(pieces(documents, path or tokenizer_path(TOKENIZER), capacity, sand, keep_ids=True), capacity, sand, keep_ids=True)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(inside, F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), ids.alias("ids"))


def place_documents(documents: DataFrame, path: str | None = None, capacity: int = WINDOW, sand: int = SAND) -> DataFrame:
    """Every document's pieces and their places, without the ids."""
    return place(pieces(documents, path or tokenizer_path(TOKENIZER), capacity, sand), capacity, sand)
