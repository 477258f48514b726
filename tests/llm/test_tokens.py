import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import common, huffman, packing, tokens


@pytest.fixture(scope="module")
def encode():
    return tokens.Encoder(tokens.tokenizer_path())


def whole(encode, text):
    return encode.tokenizer.encode(text, add_special_tokens=False).ids


def ids_of(encode, text):
    return np.frombuffer(encode.ids(text), "<u4").tolist()


def test_pieces_give_the_ids_of_the_whole_text(encode, texts):
    rng = random.Random(1)
    for text in list(texts.values())[:100]:
        assert ids_of(encode, text) == whole(encode, text)
    for _ in range(3000):
        text = "".join(rng.choice("ab'stdrelvm 0129_-.,\n\t\r éÀÿž  <|>") for _ in range(rng.randint(0, 40)))
        assert ids_of(encode, text) == whole(encode, text)


def test_pretokens_are_cut_as_by_the_classes_of_the_tokenizer():
    cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    plain = [chr(c) for c in range(0x180) if tokens.PLAIN.match(chr(c))]
    rng = random.Random(2)
    for own in (plain, " 'strevmld\n", " a0_\té"):
        for _ in range(2000):
            text = "".join(rng.choice(own) for _ in range(rng.randint(0, 30)))
            assert tokens.PIECES.findall(text) == cut.findall(text)


def test_a_pretoken_is_looked_up_once_and_remembered_up_to_the_limit():
    encode = tokens.Encoder(tokens.tokenizer_path(), remembered=2)
    calls, real = [], encode.known.tokenize
    encode.known.tokenize = lambda word: calls.append(word) or real(word)
    for _ in range(2):
        assert ids_of(encode, "one two six one") == whole(encode, "one two six one")
    assert len(encode.known) == 2 and [c.strip("Ġ") for c in calls] == ["one", "two", "six", "one", "six", "one"]
    # clearing what a worker keeps frees it at once, with no reference that goes round
    gone = weakref.ref(encode)
    encode.known.tokenize = None
    del encode
    assert gone() is None


@pytest.mark.parametrize("text", ["", "<|endoftext|> x", "日本語 text", "a b c", "\x1c\x85 d", "😀" * 5])
def test_other_characters_go_through_the_library(encode, text):
    assert ids_of(encode, text) == whole(encode, text)


def expected(encode, texts):
    return {k: encode.ids(t) + bytes(4) for k, t in texts.items()}


def test_packing_places_every_piece(documents, texts, encode):
    placed = packing.pack_documents(documents).toPandas().sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    total = placed.length.sum()
    assert placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.sequence_id.nunique() <= -(-total // 2048) + 1
    for doc_id, own in expected(encode, texts).items():
        rows = placed[placed.doc_id == doc_id].sort_values("piece")
        assert rows.piece.tolist() == list(range(len(rows))) and rows.length.sum() == len(own) // 4
        assert (rows.length.iloc[1:] == 2048).all()
        for r in rows.itertuples():
            assert zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_packed_sequences_hold_the_ids(documents, texts, encode):
    placed = packing.pack_documents(documents, keep_ids=True)
    whole_sequences = {r.sequence_id: bytes(r.ids) for r in packing.packed_sequences(placed).collect()}
    own = expected(encode, texts)
    for r in placed.drop("ids").collect():
        part = whole_sequences[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
        assert part == own[r.doc_id][4 * r.start : 4 * (r.start + r.length)]


def plain_best_fit(sizes, capacity):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= size]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - size)
        else:
            bins.append(capacity - size)
    return sorted(bins)


def test_runs_equal_plain_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        filled, seen = {}, {}
        for length, rank, n, first, offset in packing.best_fit_runs(counts, capacity):
            for k in range(n):
                assert (length, rank + k) not in seen
                seen[length, rank + k] = True
                filled.setdefault(first + k, []).append((offset, length))
        assert len(seen) == len(sizes)
        for places in filled.values():
            places.sort()
            assert all(o == sum(s for _, s in places[:k]) for k, (o, _) in enumerate(places))
        assert sorted(capacity - sum(s for _, s in p) for p in filled.values()) == plain_best_fit(sizes, capacity)


def test_tightest_bin():
    rng, tree, open_ = random.Random(3), packing.TightestBin(50), set()
    for _ in range(2000):
        r = rng.randint(0, 50)
        open_ ^= {r}
        tree.set(r, r in open_)
        least = rng.randint(0, 50)
        assert tree.find(least) == min((x for x in open_ if x >= least), default=None)


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 1000, 300)
    lengths = huffman.code_lengths(counts, 20)
    import heapq

    heap = [(int(c), k) for k, c in enumerate(counts) if c]
    cost, k = 0, 1000
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1))
    assert int((lengths.astype(int) * counts).sum()) == cost
    steep = np.array([2**k for k in range(30)])
    short = huffman.code_lengths(steep, 6)
    assert short.max() <= 6 and sum(2.0 ** -int(x) for x in short) == 1.0


def test_bits_round_trip_in_blocks():
    rng = np.random.default_rng(5)
    for n in (1, 511, 512, 513, 5000):
        ids = np.minimum(rng.geometric(0.05, n), 49)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=50))
        stream, checkpoints = huffman.encode_bits(ids, huffman.canonical_codes(lengths), lengths)
        assert huffman.decode_bits(stream, checkpoints, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_files_give_the_ids_back(documents, texts, encode, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_DOCS", 30)
    monkeypatch.setattr(huffman, "SEGMENT", 5_000)
    back = sorted(huffman.round_trip(documents.repartition(3), keep_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, (doc_id, own) in zip(back, sorted(expected(encode, texts).items()), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, at, len(own) // 4, zlib.crc32(own), own)
        at += len(own) // 4


def test_odd_and_empty_tables(odd, empty, encode):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    back = huffman.round_trip(odd).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.ids_crc32) for r in back), key=key) == sorted(((d, zlib.crc32(encode.ids(t) + bytes(4))) for d, t in rows), key=key)
    placed = packing.pack_documents(odd)
    assert placed.agg({"length": "sum"}).first()[0] == sum(len(encode.ids(t)) // 4 + 1 for _, t in rows)
    assert huffman.round_trip(empty).count() == 0 and packing.pack_documents(empty).count() == 0


def test_packing_hands_workers_few_texts_at_once(spark, monkeypatch):
    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.written
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "written", lambda df, label: seen.append(int(spark.conf.get(name))) or written(df, label))
    docs = spark.range(0, 1203, 1, 1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    placed = packing.pack_documents(docs)
    assert placed.count() == 1203 and seen == [packing.TEXTS] and spark.conf.get(name) == before
    with common.arrow_rows(spark, 500):
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long").collect()
    assert sorted(r.n for r in sizes) == [203, 500, 500]


def test_ids_are_counted_where_they_are_made(documents, texts, encode, spark):
    path = tokens.tokenizer_path()
    ids = huffman.tokenized(documents, path, [])
    rows = ids.where("bucket = -1").collect()
    assert ids.where("bucket >= 0").count() == len(texts) and 0 < len(rows) <= documents.rdd.getNumPartitions()
    every = np.frombuffer(b"".join(expected(encode, texts).values()), "<u4")
    want = np.bincount(every, minlength=encode.tokenizer.get_vocab_size())
    assert np.array_equal(huffman.id_counts(ids, len(want)), want)
    assert np.array_equal(sum(np.frombuffer(r.ids, "<i8") for r in rows), want)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
