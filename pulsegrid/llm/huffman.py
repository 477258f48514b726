"""Token ids on disk: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

Layout of a written folder, all Parquet, so that any store Spark reaches can hold it:

* ``codebook``: one row, the code length of every id (one byte each, 0: does not occur). Codes are
  canonical, so lengths are all a reader needs.
* ``segments/bucket=N``: one file per range of doc_id, buckets ascending, documents ascending within.
  A row is a segment: its number, n_docs, n_tokens, the documents' ids and token counts, the bit offset
  of every block of ``BLOCK`` ids, and the bit stream.

A block decodes without the others; a reader decodes all blocks of a segment in step, each with one
look-up per id in a table of 2 ** max_bits entries. The limit on code lengths follows the number of ids
in use, three bits above what equal lengths would take, at most MAX_BITS.

Null text is empty; a null doc_id sorts first; rows that repeat a doc_id are written one after another.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import arrow_rows, shared_dir, tidy, written
from pulsegrid.llm.tokens import encoder, tokenizer_path

END_ID = 0
MAX_BITS = 20
#: Ids in a block, and least ids in a segment unless its file ends.
BLOCK, SEGMENT = 512, 1 << 20
#: Documents in a file, and most files.
FILE_DOCS, MOST_FILES = 8192, 10_000
#: Texts a worker is handed at once, and the bucket of the row in which a task counts its ids.
AT_ONCE, COUNTS = 512, -1


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 where the count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    row, leaves = weights, [np.ones(n, bool)]
    for _ in range(most - 1):
        even = len(row) // 2 * 2
        both = np.concatenate([weights, row[0:even:2] + row[1:even:2]])
        sort = np.argsort(both, kind="stable")
        row = both[sort]
        leaves.append(sort < n)
    take = 2 * n - 2
    own = np.zeros(n, np.uint8)
    for is_leaf in reversed(leaves):
        single = int(is_leaf[:take].sum())
        own[:single] += 1
        take = 2 * (min(take, len(is_leaf)) - single)
    lengths[order] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    per_length = np.bincount(lengths, minlength=1)
    for bits in range(1, len(per_length)):
        code <<= bits - last
        last = bits
        own = np.flatnonzero(lengths == bits)
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code += len(own)
    return codes


def length_limit(counts: np.ndarray) -> int:
    return min(MAX_BITS, int(max(np.count_nonzero(counts), 2) - 1).bit_length() + 3)


def decode_table(lengths: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Id * 32 + code length for every value of the next ``most`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (most - lengths[order].astype(np.int64))
    return np.repeat(order << 5 | lengths[order], spans).astype(np.uint32)


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream (most significant bit first) and the bit offset of every block."""
    both = (codes << np.uint64(6) | lengths)[ids]  # one look-up for both
    size = (both & np.uint64(63)).view(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    placed = both >> np.uint64(6) << (64 - (starts & 31) - size).view(np.uint64)
    word = starts >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    whole = np.bitwise_or.reduceat(placed, first)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    at = word[first]
    out[at] |= whole >> np.uint64(32)
    out[at + 1] |= whole & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::BLOCK].copy()


def decode_bits(stream: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """All blocks in step: the k-th id of each at the k-th step."""
    raw = np.frombuffer(stream + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last = checkpoints.astype(np.int64), len(checkpoints) - 1
    out = np.zeros((BLOCK, len(checkpoints)), np.uint32)
    for k in range(min(BLOCK, n)):
        if k == n - last * BLOCK:  # the last block is shorter
            at = at[:-1]
        key = window.take(at >> 3)
        key <<= (at & 7).astype(np.uint32)
        key >>= np.uint32(32 - most)
        entry = table.take(key)
        out[k, : len(at)] = entry
        at = at + (entry & np.uint32(31))
    return (out.T.reshape(-1) >> np.uint32(5))[:n]


def tokenized(documents: DataFrame, path: str, bounds: list[int]) -> DataFrame:
    """doc_id, bucket and ids (little-endian, 16 bits where the vocabulary allows), written once.

    Every task adds a row of bucket COUNTS, whose ids are how often it has written each id, in 64 bits.
    """
    edges = np.array(bounds, np.int64)

    def run(batches):
        encode = encoder(path)
        vocabulary = encode.tokenizer.get_vocab_size()
        small = vocabulary <= 1 << 16
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = []
                for text in part.column(1):
                    own = encode.ids(text.as_py() or "") + np.uint32(END_ID).tobytes()
                    ids.append(np.frombuffer(own, "<u4").astype("<u2").tobytes() if small else own)
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2" if small else "<u4"), minlength=vocabulary)
                keys = part.column(0).to_numpy(zero_copy_only=False) if not part.column(0).null_count else np.array([x if x is not None else np.iinfo(np.int64).min for x in part.column(0).to_pylist()])
                buckets = np.searchsorted(edges, keys.astype(np.int64), side="left").astype(np.int32)
                width = np.full(len(ids), 2 if small else 4, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(buckets), pa.array(width), pa.array(ids, pa.binary())], names=["doc_id", "bucket", "width", "ids"])
        row = [[None], [COUNTS], [8], [total.astype("<i8").tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["doc_id", "bucket", "width", "ids"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    source = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with arrow_rows(documents.sparkSession, AT_ONCE):
        return written(source.mapInArrow(tidy(run, "tokens"), "doc_id long, bucket int, width int, ids binary"), "ids")


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: the counts of all tasks, added per task and then by Spark."""

    def run(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for own in batch.column(0):
                total += np.frombuffer(own.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts, rows = np.zeros(vocabulary, np.int64), ids.where(F.col("bucket") == COUNTS).select("ids")
    for row in rows.mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.id] = row.n
    return counts


def file_bounds(documents: DataFrame) -> list[int]:
    """Largest doc_id of every file but the last: quantiles, as many as the number of documents asks for."""
    files = min(MOST_FILES, -(-documents.count() // FILE_DOCS))
    if files <= 1:
        return []
    at = F.percentile_approx("doc_id", [k / files for k in range(1, files)], 10 * MOST_FILES)
    return sorted(set(documents.select(at.alias("q")).first().q or []))


def write_ids(documents: DataFrame, folder: str, path: str | None = None) -> None:
    """Encodes ``documents`` (doc_id, text) and writes the files to ``folder``."""
    spark, path = documents.sparkSession, path or tokenizer_path()
    bounds = file_bounds(documents)
    ids = tokenized(documents, path, bounds)
    counts = id_counts(ids, encoder(path).tokenizer.get_vocab_size())
    most = length_limit(counts)
    lengths = code_lengths(counts, most)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(most, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").write.parquet(f"{folder}/codebook")
    schema = pa.schema([("bucket", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())), ("stream", pa.binary())])

    def segment(bucket, number, docs, held):
        stream, checkpoints = encode_bits(np.concatenate(held), codes, lengths)
        sizes = [len(x) for x in held]
        row = [[bucket], [number], [len(docs)], [sum(sizes)], [docs], [sizes], [checkpoints.tolist()], [stream]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

    def run(batches):
        at, number, docs, held, n = None, 0, [], [], 0
        for batch in batches:
            for doc_id, bucket, width, own in zip(*(batch.column(k) for k in range(4))):
                bucket = bucket.as_py()
                if docs and (bucket != at or n >= SEGMENT):
                    yield segment(at, number, docs, held)
                    number, docs, held, n = number + 1, [], [], 0
                if bucket != at:
                    at, number = bucket, 0
                docs.append(doc_id.as_py())
                held.append(np.frombuffer(own.as_py(), f"<u{width.as_py()}"))
                n += len(held[-1])
        if docs:
            yield segment(at, number, docs, held)

    ordered = ids.where(F.col("bucket") != COUNTS).repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())
    ddl = "bucket int, segment int, n_docs long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, stream binary"
    ordered.mapInArrow(tidy(run), ddl).write.option("compression", "uncompressed").partitionBy("bucket").parquet(f"{folder}/segments")


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with ``keep_ids`` the ids."""
    ddl = "segment int, n_docs long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, stream binary, bucket int"
    segments = spark.read.schema(ddl).parquet(f"{folder}/segments")
    book = spark.read.parquet(f"{folder}/codebook").first()
    table = decode_table(np.frombuffer(book.lengths, np.uint8), book.max_bits)
    sizes = segments.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.select("bucket", F.coalesce(F.sum("n").over(before.orderBy("bucket")), F.lit(0)).alias("file_start"))
    inside = F.sum("n_tokens").over(before.partitionBy("bucket").orderBy("segment"))
    places = segments.select("bucket", "segment", F.coalesce(inside, F.lit(0)).alias("segment_start")).join(files, "bucket")
    places = places.select("bucket", "segment", (F.col("file_start") + F.col("segment_start")).alias("base"))
    names = ["bucket", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, segment, n, docs, tokens, checkpoints, stream = (batch.column(k)[row].as_py() for k in range(7))
                ids = decode_bits(stream, np.array(checkpoints), n, table, book.max_bits).astype("<u4")
                ends = np.cumsum(tokens)
                own = [ids[e - t : e].tobytes() for e, t in zip(ends, tokens)]
                columns = [[bucket] * len(docs), [segment] * len(docs), docs, ends - tokens, tokens, [zlib.crc32(x) for x in own]] + [own] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    out = "bucket int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    chosen = segments.select("bucket", "segment", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "stream")
    decoded = chosen.mapInArrow(tidy(run), out).join(places, ["bucket", "segment"])
    return decoded.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), *names[4:])


def round_trip(documents: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Writes ``documents`` to a new folder under the shared one and reads it back."""
    folder = f"{shared_dir(documents.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents, folder, path)
    return read_ids(documents.sparkSession, folder, keep_ids)
