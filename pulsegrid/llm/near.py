"""Near duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document is its set of distinct word shingles. Each shingle's hash names one of ``REGISTERS`` buckets;
a bucket keeps its smallest hash as the count of leading zeros and the ``MANTISSA`` bits after the first
one. ``BANDS`` keys of ``ROWS`` registers bring candidates together.

Small sets enter every shingle under ``COPIES`` hashes so that buckets fill; sets near the size where
that ends are banded both ways, so a similar pair always has one way in common.

Equal sets are one node. All nodes that share a band key are in the canopy of the most connected one of
them, so any two of them meet there. Within a canopy, collision-corrected Jaccard estimates of all pairs
leave the nodes that may have a link at all; these are compared on their full sets. Both steps work on
blocks of bounded size, as matrix operations whose results leave the task as a list of nodes and as a
forest of links: no pair is lost and no group emits its square.

Null and empty texts have no shingle and link with nothing. Rows that repeat a doc_id are separate
rows. Further columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import components, text_bytes, tidy, written

REGISTERS, MANTISSA = 256, 10
#: A pair at 0.8 shares no band with a probability of 3e-6, at 0.85 of 2e-9.
BANDS, ROWS = 42, 6
EMPTY = 0xFFFF
#: Sets below SMALL enter each shingle COPIES[0] times, others COPIES[1] times.
SMALL, COPIES = 64, (32, 4)
#: Expected share of equal registers of unrelated sets is this times 2 ** -MANTISSA (published for HyperMinHash).
COLLISION = 0.1699
#: Standard errors below the threshold at which an estimate still leads to verification.
MARGIN = 6
#: Nodes and bytes of sets in a block of a canopy, and columns multiplied at once.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def sketch(items: np.ndarray, copies: int) -> np.ndarray:
    """Registers: leading zeros and mantissa of each bucket's smallest hash, EMPTY without any."""
    bits = 64 - (REGISTERS.bit_length() - 1)
    low = np.full(REGISTERS, np.uint64(1 << bits) - np.uint64(1), np.uint64)
    used = np.zeros(REGISTERS, bool)
    for k in range(copies):
        h = mixed(items + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        bucket = (h >> np.uint64(bits)).astype(np.int64)
        used[bucket] = True
        np.minimum.at(low, bucket, h & np.uint64((1 << bits) - 1))
    low = np.maximum(low, np.uint64(1))
    top = np.floor(np.log2(low.astype(np.float64))).astype(np.int64)
    top -= (low >> top.astype(np.uint64)) == 0  # rounded up to the next power of two
    zeros = np.minimum(bits - 1 - top, 62)
    shifted = low << (63 - top).astype(np.uint64)
    mantissa = (shifted << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return np.where(used, zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa, EMPTY).astype(np.uint16)


def ways(n: int, percent: int) -> list[int]:
    """Which of COPIES a set of ``n`` shingles is banded with."""
    edge = SMALL * percent / 100, SMALL * 100 / percent
    return [k for k in (0, 1) if (n < edge[1] if k == 0 else n >= edge[0])]


def band_keys(registers: np.ndarray, way: int) -> list[int]:
    """Keys of the bands that hold any register."""
    rows = registers[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(2 * BANDS, dtype=np.uint64)[way::2]
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64))
    return keys[(rows != EMPTY).any(axis=1)].astype(np.int64).tolist()


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of every row of ``a`` with every row of ``b``, and the registers each rests on.

    Corrected for equal registers of different shingles; registers that are empty on both sides say nothing.
    """
    equal = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    empty = ((a == EMPTY).astype(np.float32) @ (b == EMPTY).astype(np.float32).T).astype(np.int64)
    n = np.maximum(a.shape[1] - empty, 1)
    chance = COLLISION / (1 << MANTISSA)
    return ((equal - empty) / n - chance) / (1 - chance), n


def sketched(documents: DataFrame, size: int, percent: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, set_hash, small and large registers (null where not banded so), ``carried`` and row; written."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, hashes, registers = [], [], ([], [])
                for text in text_bytes(part.column(1)):
                    own = shingles(text, size)
                    n.append(len(own))
                    hashes.append(xxhash.xxh3_128_digest(own.tobytes()))
                    used = ways(len(own), percent) if len(own) else []
                    for k in (0, 1):
                        registers[k].append(sketch(own, COPIES[k]).tobytes() if k in used else None)
                columns = [pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), *(pa.array(r, pa.binary()) for r in registers)]
                more = [part.column(2 + k) for k in range(len(carried))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *more], names=["doc_id", "n", "set_hash", "r0", "r1", *carried])

    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carried)
    kinds = "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in carried)
    out = source.mapInArrow(tidy(run), "doc_id long, n long, set_hash binary, r0 binary, r1 binary" + kinds)
    return written(out.withColumn("row", F.monotonically_increasing_id()), "sketches")


def banded(nodes: DataFrame) -> DataFrame:
    """(key, id) of every band of every node."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for id, *registers in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for way, own in enumerate(registers):
                    if own is not None:
                        found = band_keys(np.frombuffer(own, np.uint16), way)
                        keys += found
                        ids += [id] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["key", "id"])

    return nodes.select("id", "r0", "r1").mapInArrow(run, "key long, id long")


def canopies(nodes: DataFrame) -> DataFrame:
    """(leader, id) of all canopies, the leaders included."""
    bands = banded(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = written(bands.join(shared, "key"), "bands")
    degree = members.groupBy("id").agg(F.sum("c").alias("degree"))
    # degree and id in one number, so that the leader is a plain maximum
    rank = F.col("degree").cast("decimal(38,0)") * F.lit(Decimal(2**63)) + F.col("id")
    ranked = members.select("key", "id").join(degree, "id").select("key", "id", rank.alias("rank"))
    leaders = ranked.groupBy("key").agg(F.max("rank").alias("rank"))
    leaders = leaders.select("key", (F.col("rank") % F.lit(Decimal(2**63))).cast("long").alias("leader"))
    pairs = members.select("key", "id").join(leaders, "key").select("leader", "id").distinct()
    return written(pairs, "canopies")


def in_blocks(found: DataFrame, data: DataFrame, size: Column, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Canopies as blocks of about BLOCK nodes and BLOCK_BYTES: (blocks, pairs of different blocks of one canopy).

    ``columns`` of ``data`` are gathered as arrays; of the second block they have the suffix 2.
    """
    placed = found.join(data, "id")
    several = placed.groupBy("leader").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).alias("blocks"))
    placed = placed.join(several.where("n > 1"), "leader").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    gathered = placed.groupBy("leader", "block", "blocks").agg(*[F.collect_list(F.coalesce(c, F.lit(b"")) if c in ("r0", "r1") else c).alias(c) for c in columns])
    large = written(gathered.where("blocks > 1"), "blocks")
    other = large.select("leader", F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in columns])
    across = large.join(other, "leader").where("block < block2")
    return gathered, across.select(*columns, *[f"{c}2" for c in columns])


def hopeful(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (leader, id) whose node has an estimate within the canopy that does not rule out a link."""
    t = percent / 100

    def near(a: list[bytes], b: list[bytes]) -> np.ndarray:
        """Rows of registers against each other; rows without registers of this way are near nothing."""
        out = np.zeros((len(a), len(b)), bool)
        rows, columns = (np.flatnonzero([len(x) > 0 for x in side]) for side in (a, b))
        if len(rows) and len(columns):
            left, right = (np.frombuffer(b"".join(side), np.uint16).reshape(-1, REGISTERS) for side in (a, b))
            j, n = estimates(left, right)
            out[np.ix_(rows, columns)] = j >= t - MARGIN * np.sqrt(t * (1 - t) / n)
        return out

    def kept(batches):
        for batch in batches:
            rows = [[], []]
            for leader, ids, r0, r1 in zip(*(batch.column(k).to_pylist() for k in range(4))):
                close = near(r0, r0) | near(r1, r1)
                np.fill_diagonal(close, False)
                own = np.flatnonzero(close.any(axis=1))
                rows[0] += [leader] * len(own)
                rows[1] += [ids[k] for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["leader", "id"])

    def kept_across(batches):
        for batch in batches:
            for leader, ids, r0, r1, _, ids2, r02, r12 in zip(*(batch.column(k).to_pylist() for k in range(8))):
                close = near(r0, r02) | near(r1, r12)
                own = [ids[k] for k in np.flatnonzero(close.any(axis=1))] + [ids2[k] for k in np.flatnonzero(close.any(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.array([leader[0]] * len(own), pa.int64()), pa.array(own, pa.int64())], names=["leader", "id"])

    registers = nodes.select("id", "r0", "r1")
    size = F.octet_length(F.coalesce("r0", F.lit(b""))) + F.octet_length(F.coalesce("r1", F.lit(b"")))
    inside, across = in_blocks(found.withColumn("of", F.col("leader")), registers, size, ["of", "id", "r0", "r1"])
    inside = inside.select("leader", "id", "r0", "r1").mapInArrow(tidy(kept), "leader long, id long")
    return written(inside.unionByName(across.mapInArrow(kept_across, "leader long, id long")).distinct(), "hopeful")


def sets_of(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id and the sorted shingle hashes of the wanted nodes, from the text of each node's first row."""
    needed = nodes.join(wanted, "id", "left_semi").select(F.col("id"), F.col("doc_id").alias("rep"), "set_hash")
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.join(needed, texts.doc_id.eqNullSafe(needed.rep)).select("id", "set_hash", "text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, sets = [], []
                for id, expected, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), text_bytes(part.column(2))):
                    own = shingles(text, size).tobytes()
                    if xxhash.xxh3_128_digest(own) == expected:  # rows may repeat a doc_id with another text
                        ids.append(id)
                        sets.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "items"])

    return found.mapInArrow(tidy(run), "id long, items binary").dropDuplicates(["id"])


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets are linked with which others (by default with each other), by exact intersections."""
    rows = sets + (others or [])
    n = len(sets)
    sizes = np.array([len(x) for x in rows])
    items, column = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    several = np.bincount(column, minlength=len(items)) > 1  # an item of one set is in no intersection
    number = np.cumsum(several) - 1
    keep = several[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, len(rows) - n if others else n), np.float32)
    width = int(several.sum())
    cuts = np.searchsorted(column, np.arange(0, width + COLUMNS, COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = np.zeros((len(rows), min(COLUMNS, width - k * COLUMNS)), np.float32)
        part[row[a:b], column[a:b] - k * COLUMNS] = 1
        common += part[:n] @ (part[n:] if others else part).T
    common = common.astype(np.int64)
    union = sizes[:n, None] + sizes[None, n:] - common if others else sizes[:, None] + sizes[None, :] - common
    return 100 * common >= percent * union


def forest(links: np.ndarray, ids: list[int], others: list[int] | None) -> list[tuple[int, int]]:
    """Edges that connect what ``links`` connects, fewer than there are nodes."""
    nodes = ids + (others or [])
    n = len(ids)
    root = np.arange(len(nodes))
    edges = []
    for k in range(n):
        near = np.flatnonzero(links[k]) + (n if others else 0)
        mine = root[k]
        for r in np.unique(root[near]):
            if r != mine:
                edges.append((nodes[k], nodes[near[root[near] == r][0]]))
                root[root == r] = mine
    return edges


def canopy_links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect all linked nodes of each canopy."""

    def alone(batches):
        for batch in batches:
            edges = []
            for ids, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [np.frombuffer(x, np.uint64) for x in items]
                edges += forest(linked(own, None, percent), ids, None) if len(ids) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def crossed(batches):
        for batch in batches:
            for ids, items, ids2, items2 in zip(*(batch.column(k).to_pylist() for k in range(4))):
                own, other = ([np.frombuffer(x, np.uint64) for x in y] for y in (items, items2))
                edges = forest(linked(own, other, percent), ids, ids2)
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    inside, across = in_blocks(found, sets, F.octet_length("items"), ["id", "items"])
    inside = inside.select("id", "items").mapInArrow(tidy(alone), "a long, b long")
    return inside.unionByName(across.mapInArrow(crossed, "a long, b long"))


def links(documents: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """id and component_id of all nodes."""
    found = hopeful(canopies(nodes), nodes, percent)
    sets = sets_of(documents, nodes, found.select("id").distinct(), size)
    edges = written(canopy_links(found, sets, percent), "links")
    return written(components(nodes.select("id"), edges), "components")


def near_groups(documents: DataFrame, size: int = 5, percent: int = 80, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, and ``first``: one row of each component.

    ``size`` words make a shingle; pairs with a Jaccard similarity of ``percent`` or more are linked.
    The columns ``carried`` of ``documents`` are in the result too.
    """
    rows = sketched(documents, size, percent, carried)
    sets = rows.where("n > 0").groupBy("set_hash").agg(F.min("row").alias("id"))
    nodes = rows.withColumnRenamed("row", "id").join(sets.select("id"), "id", "left_semi")
    nodes = written(nodes.select("id", "doc_id", "n", "set_hash", "r0", "r1"), "nodes")
    state = links(documents, nodes, size, percent)
    of_set = nodes.select("id", "set_hash").join(state, "id").select("set_hash", F.col("component_id").alias("root"))
    placed = rows.drop("r0", "r1").join(of_set, "set_hash", "left").withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    placed = written(placed.select("doc_id", "n", F.coalesce("root", "row").alias("root"), "row", *carried), "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(least, "root")
    first = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("first_row"))
    return named.join(first, "root").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        (F.col("row") == F.col("first_row")).alias("first"),
        *carried,
    )


def drop_near_copies(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component, the first with its smallest doc_id; all columns kept.

    Rows are known by a digest of doc_id and text, so no numbered copy of the texts is written. Of rows that
    share both, the least by all columns stays; without any word they link with nothing and all stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)))
    groups = near_groups(documents.select("doc_id", "text", mark.alias("mark")), size, percent, ("mark",))
    stays = groups.groupBy("mark").agg(
        F.max("first").alias("first"), ((F.count(F.lit(1)) > 1) & (F.max("n_shingles") > 0)).alias("repeated")
    )
    stays = written(stays.where("first").select("mark", "repeated"), "stays")
    marked = documents.select(F.struct("*").alias("row"), mark.alias("mark"))
    alone = marked.join(stays.where("NOT repeated"), "mark", "left_semi").select("row")
    if not stays.where("repeated").isEmpty():
        copies = marked.join(stays.where("repeated"), "mark", "left_semi")
        alone = alone.unionByName(copies.groupBy("mark").agg(F.min("row").alias("row")).select("row"))
    return alone.select("row.*")
