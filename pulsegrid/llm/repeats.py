"""Removal of repeated byte strings: suffix order of shards by external induced sorting.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller
doc_id. To bring equal strings together without shipping every suffix, a string belongs to the place
in it whose ``GRAM`` bytes hash lowest: equal strings have equal such grams at equal offsets, so no match
is lost. Strings of one place are neighbours; their bytes make one piece.

Documents are dealt to buckets by their id, and all that is learned about them goes back to their bucket, in
rows of arrays: one for each range or shard that has something for it, however many documents it is about.

1. Every bucket sends half the hash of each gram once a batch; grams that only one document has end there. A
   gram is long enough that texts of a few syllables or words seldom share one without sharing more.
2. Buckets come together with their shared grams and send a hash of each piece that belongs to one.
   Of equal pieces all but those of the smallest doc_id are repeats; a piece whose gram no different
   piece has is settled by that.
3. The remaining pieces go, once each, to the shard their gram hashes to. A shard puts their suffixes in
   order with their common prefixes (``induced``). In a run of suffixes that share ``LENGTH`` bytes, all
   but those of the smallest doc_id are repeats. A gram with ``OFTEN`` pieces or more would make one large
   shard: its strings go by their own hashes instead, and equal hashes are equal strings.
4. The repeated ranges meet their document again, are joined and cut out.

A hot string or piece is sent once per batch at most. Null text is empty; a null doc_id is below
all others; rows that repeat a doc_id do not repeat each other. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import partitions, text_bytes, tidy
from pulsegrid.llm.induced import suffixes
from pulsegrid.llm.near import mixed

#: A gram is whole words of eight bytes. The shorter it is, the more pieces that share nothing else meet, and their
#: share grows with the input; the longer, the fewer strings a place has.
LENGTH, GRAM = 50, 24
#: Text bytes of a batch (a longer document is one of its own), and of what is hashed at once, whose
#: places need PLACE_BITS.
BATCH, AT_ONCE, PLACE_BITS = 6 << 20, 1 << 20, 24
#: Pieces of one gram from which on its strings are dealt by their own hashes.
OFTEN = 1 << 16
#: Text bytes for each range of keys, whose anchors take about as many.
RANGE = 64 << 20
#: Buckets of documents for each range, so that partitions get about equally many.
BUCKETS = 2
#: Bytes of a shard if every text byte were in as many pieces as it can be, about five.
SHARD, MOST_PIECES = 32 << 20, 5
NULL_ID = np.iinfo(np.int64).min


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes at every place."""
    n = len(data) - GRAM + 1
    word = np.empty(n + GRAM - 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        own = word[k::8]
        own[: min(len(own), len(part))] = part[: len(own)]
    h = word[:n].copy()
    for at in range(8, GRAM, 8):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += word[at : n + at]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    return h


def lowest_places(h: np.ndarray) -> np.ndarray:
    """For each string the place of its lowest gram hash, the leftmost of equal ones."""
    v = h >> np.uint64(PLACE_BITS)
    v <<= np.uint64(PLACE_BITS)
    v |= np.arange(len(h), dtype=np.uint64)
    grams, width = LENGTH - GRAM + 1, 1
    while 2 * width <= grams:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < grams:
        v = np.minimum(v[: len(v) - (grams - width)], v[grams - width :])
    v &= np.uint64((1 << PLACE_BITS) - 1)
    return v.view(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, first string, last string) of every place that strings belong to.

    Strings are given by their start within the text. Texts shorter than LENGTH have none. A text too
    long for PLACE_BITS is cut into parts that overlap, so that every string is whole in one.
    """
    parts, group, size = [], [], 0
    step = (1 << PLACE_BITS) - 2 * LENGTH

    def flush():
        lengths = np.array([len(t) for _, _, t in group])
        ends = np.cumsum(lengths)
        data = b"".join(t for _, _, t in group)
        if len(data) < LENGTH:
            return
        h = gram_hashes(data)
        place = lowest_places(h)
        # the last LENGTH - 1 starts of a text are no strings of it
        outside = (ends[:, None] - np.arange(1, LENGTH)).reshape(-1)
        place[outside[(outside >= 0) & (outside < len(place))]] = -1
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(place)]]) - 1
        inside = place[first] >= 0
        first, last = first[inside], last[inside]
        text = np.searchsorted(ends, first, side="right")
        at = (ends - lengths - np.array([a for _, a, _ in group]))[text]
        parts.append((h[place[first]], np.array([k for k, _, _ in group])[text], first - at, last - at))

    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 1), step):
            part = t[at : at + step + LENGTH - 1] if len(t) > step else t
            if size and size + len(part) > AT_ONCE:
                flush()
                group, size = [], 0
            group.append((k, at, part))
            size += len(part)
    if group:
        flush()
    if not parts:
        return tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def bucket_of(ranges: int):
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS * ranges)).cast("int")


def with_bucket(texts: DataFrame, ranges: int) -> DataFrame:
    return texts if "bucket" in texts.columns else texts.withColumn("bucket", bucket_of(ranges))


def batches_of(batches, answer: str | None = None):
    """(bucket, ids, texts, answer) in batches of about BATCH bytes, each of one bucket.

    What the column ``answer`` holds is for its row and those behind it in the same bucket, until a row has another.
    """
    held, size = {}, 0  # per bucket
    answers, at = None, None

    def out():
        for b, (ids, texts) in held.items():
            yield b, np.array(ids, np.int64), texts, answers
        held.clear()

    for batch in batches:
        given = batch.column(answer) if answer else None
        rows = zip(batch.column("bucket").to_pylist(), batch.column("id").to_pylist(), text_bytes(batch.column("text")))
        for k, (bucket, key, text) in enumerate(rows):
            if answer and (bucket != at or given[k].is_valid):
                yield from out()
                size, at, answers = 0, bucket, given[k].as_py()
            ids, texts = held.setdefault(bucket, ([], []))
            ids.append(key)
            texts.append(text)
            size += len(text)
            if size >= BATCH:
                yield from out()
                size = 0
    yield from out()


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all (sorted) columns stay the same."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    fresh = np.zeros(len(columns[0]), bool)
    fresh[0] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range of evenly spread keys; keys of anchors crowd at low values and must be ``mixed`` first."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


def halves(keys: np.ndarray) -> np.ndarray:
    """The half of each key by which shared grams are known: within a range and within a bucket few differ in the other half only."""
    return keys.astype(np.uint32)


def shared_grams(texts: DataFrame, ranges: int) -> DataFrame:
    """bucket and keys (halves of a part of them): the grams of a bucket that more than one document has, and few others."""

    def send(batches):
        for bucket, ids, texts, _ in batches_of(batches):
            key, number, _, _ = anchors(texts)
            if not len(key):
                continue
            doc, spread = ids[number], mixed(key)
            order = np.argsort(spread)
            key, doc, spread = key[order], doc[order], spread[order]
            heads = heads_of(spread)
            several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
            key = halves(key[heads])
            cuts = np.searchsorted(range_of(spread[heads], ranges), np.arange(ranges + 1))
            own = np.flatnonzero(np.diff(cuts)).tolist()
            rows = [(r, bucket, key[cuts[r] : cuts[r + 1]].tobytes(), np.packbits(several[cuts[r] : cuts[r + 1]]).tobytes()) for r in own]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["range", "bucket", "keys", "several"])

    def shared(held):
        """A gram that came twice is in two batches, so in two documents, or in two rows of one."""
        buckets, keys, several = zip(*held)
        # key, bucket and mark in one number: sorting numbers is far cheaper than sorting their order
        both = np.concatenate(keys).astype(np.uint64) << np.uint64(32)
        both |= np.repeat(np.array(buckets, np.uint64) << np.uint64(1), [len(k) for k in keys])
        both |= np.concatenate(several)
        both.sort()
        heads = heads_of(both >> np.uint64(32))
        sizes = np.diff(np.append(heads, len(both)))
        both = both[np.repeat((sizes > 1) | (np.bitwise_or.reduceat(both, heads) & np.uint64(1) > 0), sizes)]
        bucket, key = (both & np.uint64((1 << 32) - 1)) >> np.uint64(1), (both >> np.uint64(32)).astype(np.uint32)
        rows = [(int(b), np.unique(k).tobytes()) for b, k in grouped(bucket, key)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.binary())], names=["bucket", "keys"])

    def merge(batches):
        at, held = None, []
        for batch in batches:
            for r, bucket, keys, several in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if r != at and held:
                    yield shared(held)
                    held = []
                at = r
                n = len(keys) // 4
                held.append((bucket, np.frombuffer(keys, np.uint32), np.unpackbits(np.frombuffer(several, np.uint8))[:n].astype(bool)))
        if held:
            yield shared(held)

    sent = with_bucket(texts, ranges).mapInArrow(tidy(send), "range int, bucket int, keys binary, several binary")
    # as many partitions as ranges: sizes in memory are a multiple of those Spark would merge them by
    return sent.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(tidy(merge), "bucket int, keys binary")


def grouped(ids: np.ndarray, values: np.ndarray):
    """(id, its values) for every id."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    cuts = heads_of(ids)
    for a, b in zip(cuts, np.append(cuts[1:], len(ids))):
        yield ids[a], values[a:b]


#: A row is either ranges of a bucket's documents (docs, starts, ends), or hashes or pieces of a bucket for a shard, or what is asked of a bucket.
SENT = ["shard", "bucket", "docs", "starts", "ends", "keys", "hashes", "places", "sizes", "bytes"]
KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
SENT_DDL = "shard int, bucket int, docs binary, starts binary, ends binary, keys binary, hashes binary, places binary, sizes binary, bytes binary"
#: A place in a text, which is below 2 GB, and the other columns as sent.
SENT_TYPES = {"docs": np.int64, "starts": np.int32, "ends": np.int32, "keys": np.uint64, "hashes": np.uint64, "places": np.int32, "sizes": np.uint8, "bytes": bool}


def sent_row(bucket: int, shard: int | None = None, **columns: np.ndarray) -> dict:
    return {"bucket": int(bucket), "shard": shard, **{c: x.astype(SENT_TYPES[c], copy=False).tobytes() for c, x in columns.items()}}


def sent_columns(rows: list, *columns: str) -> list[np.ndarray]:
    """The columns of ``rows`` end to end; small numbers as 64 bits."""
    whole = [np.frombuffer(b"".join(r[c] for r in rows), SENT_TYPES[c]) for c in columns]
    return [x.astype(np.int64) if x.dtype in (np.int32, np.uint8) else x for x in whole]


def buckets_of(rows: list) -> np.ndarray:
    return np.repeat(np.array([r["bucket"] for r in rows], np.int32), [len(r["docs"]) // 8 for r in rows])


def sent_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(SENT, KINDS)], names=SENT)


def sent_rows(batch: pa.RecordBatch):
    """Rows of a batch that are for a shard, as dicts."""
    columns = [batch.column(c).to_pylist() for c in SENT]
    for row in zip(*columns):
        if row[0] is not None:
            yield dict(zip(SENT, row))


def ranges_of(buckets: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """One row of joined ranges per bucket."""
    if not len(docs):
        return []
    order = np.lexsort((starts, docs, buckets))
    buckets, docs, starts, ends = buckets[order], docs[order], starts[order], ends[order]
    fresh = np.zeros(len(docs), np.int64)
    fresh[heads_of(buckets, docs)] = 1
    apart = np.cumsum(fresh) << 32  # documents do not touch
    ends = np.maximum.accumulate(ends + apart)
    first = np.concatenate([[True], (starts + apart)[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(first)[1:], len(docs)) - 1
    buckets, docs, starts, ends = buckets[first], docs[first], starts[first], (ends - apart)[last]
    cuts = heads_of(buckets)
    return [sent_row(buckets[a], docs=docs[a:b], starts=starts[a:b], ends=ends[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(docs)))]


def piece_hashes(texts: DataFrame, ranges: int) -> DataFrame:
    """Hashes of the pieces of shared grams per range of keys; ``texts`` has id, text and keys (several), as ``batches_of`` reads them."""

    def run(batches):
        last, known = None, None
        for bucket, ids, texts, keys in batches_of(batches, "keys"):
            if not keys:
                continue
            if keys is not last:
                last, known = keys, np.unique(np.frombuffer(b"".join(keys), np.uint32))
            key, number, first, end = anchors(texts)
            if not len(known) or not len(key):
                continue
            # looked up in order, which is far faster
            half = halves(key)
            order = np.argsort(half)
            at = np.minimum(np.searchsorted(known, half[order]), len(known) - 1)
            mark = np.zeros(len(key), bool)
            mark[order] = known[at] == half[order]
            if not mark.any():
                continue
            key, number, first, end = key[mark], number[mark], first[mark], end[mark]
            digest = xxhash.xxh3_64_intdigest
            hashes = np.array([digest(texts[k][a : b + LENGTH]) for k, a, b in zip(number.tolist(), first.tolist(), end.tolist())], np.uint64)
            doc, size = ids[number], end - first + LENGTH
            order = np.lexsort((doc, hashes, mixed(key)))
            key, hashes, doc, first, size = (x[order] for x in (key, hashes, doc, first, size))
            heads = heads_of(key, hashes)
            least = np.repeat(doc[heads], np.diff(np.append(heads, len(doc))))
            gone = doc > least
            rows = ranges_of(np.full(int(gone.sum()), bucket, np.int32), doc[gone], first[gone], (first + size)[gone])
            key, hashes, doc, first, size = (x[~gone] for x in (key, hashes, doc, first, size))
            cuts = np.searchsorted(range_of(mixed(key), ranges), np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[r], cuts[r + 1])
                rows.append(sent_row(bucket, r, keys=key[own], hashes=hashes[own], docs=doc[own], places=first[own], sizes=size[own]))
            yield sent_batch(rows)

    return with_bucket(texts, ranges).mapInArrow(tidy(run), SENT_DDL)


def settled(sent: DataFrame, parts: int, often: int) -> DataFrame:
    """Ranges of the pieces that equal one of a smaller doc_id, and (docs, keys, places, sizes) of those left to compare, per bucket.

    ``bytes`` marks those whose gram has ``often`` such pieces or more.
    """

    def compare(held):
        bucket = buckets_of(held)
        key, hashes, doc, place, size = sent_columns(held, "keys", "hashes", "docs", "places", "sizes")
        order = np.lexsort((doc, hashes, key))
        bucket, key, hashes, doc, place, size = (x[order] for x in (bucket, key, hashes, doc, place, size))
        heads = heads_of(key, hashes)
        gone = doc > np.repeat(doc[heads], np.diff(np.append(heads, len(doc))))
        rows = ranges_of(bucket[gone], doc[gone], place[gone], (place + size)[gone])
        # keys that different pieces have
        grams = heads_of(key)
        several = np.diff(np.searchsorted(heads, np.append(grams, len(key)))) > 1
        counts = np.diff(np.append(grams, len(key)))
        left = np.repeat(several, counts) & ~gone
        frequent = np.repeat(np.add.reduceat(left, grams, dtype=np.int64) >= often, counts)
        order = np.lexsort((doc[left], bucket[left]))
        bucket, key, doc, place, size, frequent = (x[left][order] for x in (bucket, key, doc, place, size, frequent))
        cuts = heads_of(bucket)
        for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
            rows.append(sent_row(bucket[a], docs=doc[a:b], keys=key[a:b], places=place[a:b], sizes=size[a:b], bytes=frequent[a:b]))
        return sent_batch(rows)

    def run(batches):
        at, held = None, []
        for batch in batches:
            known = batch.filter(batch.column(0).is_null())
            if known.num_rows:
                yield known
            for row in sent_rows(batch):
                if row["shard"] != at and held:
                    yield compare(held)
                    held = []
                at = row["shard"]
                held.append(row)
        if held:
            yield compare(held)

    return by_shard(sent, parts).mapInArrow(tidy(run), SENT_DDL)


def by_shard(sent: DataFrame, parts: int) -> DataFrame:
    spread = F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int")
    return sent.repartition(parts, F.coalesce("shard", spread)).sortWithinPartitions("shard")


def string_hashes(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Hash of the LENGTH bytes at each of ``starts``."""
    h = gram_hashes(data)
    out = h[starts]
    for at in (*range(GRAM, LENGTH - GRAM, GRAM), LENGTH - GRAM):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[starts + at])
    return out


def strings(bucket: int, key: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, found: list[bytes], shards: int):
    """Batches of the strings of frequent grams: ranges of those known to be repeats, and hashes of the others per shard."""
    order = np.argsort(key, kind="stable")
    groups = np.cumsum(size[order]) // (2 * AT_ONCE)
    for a, b in zip(heads_of(groups), np.append(heads_of(groups)[1:], len(order))):
        own = order[a:b]
        n = size[own] - LENGTH + 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes = string_hashes(b"".join(found[k] for k in own.tolist()), np.repeat(np.cumsum(size[own]) - size[own], n) + inside)
        keys, docs, places = np.repeat(key[own], n), np.repeat(doc[own], n), np.repeat(place[own], n) + inside
        keys, hashes, docs, places, gone = repeated_strings(keys, hashes, docs, places)
        rows = ranges_of(np.full(int(gone.sum()), bucket, np.int32), docs[gone], places[gone], places[gone] + LENGTH)
        keys, hashes, docs, places = (x[~gone] for x in (keys, hashes, docs, places))
        shard = range_of(mixed(keys ^ hashes), shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            mine = by[cuts[r] : cuts[r + 1]]
            rows.append(sent_row(bucket, int(r), keys=keys[mine], hashes=hashes[mine], docs=docs[mine], places=places[mine]))
        yield sent_batch(rows)


def repeated_strings(keys: np.ndarray, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray):
    """The four columns in order, and which rows equal one of a smaller doc_id."""
    order = np.lexsort((docs, hashes, keys))
    keys, hashes, docs, places = (x[order] for x in (keys, hashes, docs, places))
    heads = heads_of(keys, hashes)
    return keys, hashes, docs, places, docs > np.repeat(docs[heads], np.diff(np.append(heads, len(docs))))


def pieces(texts: DataFrame, shards: int, ranges: int) -> DataFrame:
    """What is asked for per shard, pieces or strings; ``texts`` has id, text and ``asked`` (several), as ``batches_of`` reads them."""

    def run(batches):
        last, wanted = None, None
        for bucket, ids, texts, asked in batches_of(batches, "asked"):
            if not asked:
                continue
            if asked is not last:
                last, wanted = asked, sent_columns(asked, "docs", "keys", "places", "sizes", "bytes")
                order = np.argsort(wanted[0], kind="stable")
                wanted = [x[order] for x in wanted]
            begins, ends = (np.searchsorted(wanted[0], ids, side) for side in ("left", "right"))
            n = ends - begins
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins, n)
            if not len(index):
                continue
            doc, key, place, size, frequent = (x[index] for x in wanted)
            found = [texts[k][p : p + m] for k, p, m in zip(np.repeat(np.arange(len(ids)), n).tolist(), place.tolist(), size.tolist())]
            fits = np.array([len(x) for x in found]) == size  # rows may repeat a doc_id with another text
            own = range_of(mixed(key), shards)
            order = np.argsort(own, kind="stable")
            order = order[(fits & ~frequent)[order]]
            cuts = np.searchsorted(own[order], np.arange(shards + 1))
            rows = []
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                mine = order[cuts[r] : cuts[r + 1]]
                rows.append(sent_row(bucket, r, docs=doc[mine], places=place[mine], sizes=size[mine]) | {"bytes": b"".join(found[k] for k in mine.tolist())})
            if rows:
                yield sent_batch(rows)
            much = np.flatnonzero(fits & frequent)
            if len(much):
                yield from strings(bucket, key[much], doc[much], place[much], size[much], [found[k] for k in much.tolist()], shards)

    return with_bucket(texts, ranges).mapInArrow(tidy(run), SENT_DDL)


def shard_repeats(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts in ``data`` (pieces end to end) of strings that a smaller doc_id has too, ascending."""
    ends = np.cumsum(sizes) + np.arange(1, len(sizes) + 1)  # with a mark after each piece
    text = np.zeros(int(ends[-1]), np.uint16)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = data.astype(np.uint16) + 1  # 0 is the mark
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    room = (ends - 1)[owner] - np.arange(len(text)) >= LENGTH
    found, run_place, run_doc = [], np.empty(0, np.int64), np.empty(0, np.int64)
    carried = LENGTH  # least common prefix since the last whole string
    for places, prefix in suffixes(text, 257, LENGTH):
        whole = np.flatnonzero(room[places])
        if not len(whole):
            carried = min(carried, int(prefix.min()))
            continue
        starts = np.concatenate([[0], whole[:-1] + 1])
        least = np.minimum.reduceat(prefix[: whole[-1] + 1], starts)
        least[0] = min(int(least[0]), carried)
        tail = prefix[whole[-1] + 1 :]
        carried = int(tail.min()) if len(tail) else LENGTH
        place = places[whole]
        doc = docs[owner[place]]
        joins = least >= LENGTH
        if len(run_place) and joins[0]:
            place, doc = np.concatenate([run_place, place]), np.concatenate([run_doc, doc])
            joins = np.concatenate([[False], np.ones(len(run_place) - 1, bool), joins])
        elif len(run_place):
            found.append(run_place[run_doc > run_doc.min()])
        joins[0] = False
        heads = np.flatnonzero(~joins)
        lowest = np.minimum.reduceat(doc, heads)
        repeats = doc > np.repeat(lowest, np.diff(np.append(heads, len(doc))))
        # the last run may go on in the next block
        found.append(place[: heads[-1]][repeats[: heads[-1]]])
        run_place, run_doc = place[heads[-1] :], doc[heads[-1] :]
    if len(run_place):
        found.append(run_place[run_doc > run_doc.min()])
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    return at - owner[at]  # without the marks


def repeated_ranges(sent: DataFrame, parts: int) -> DataFrame:
    """docs, starts, ends per bucket: repeated ranges within the pieces and strings of each shard."""

    def ranges(held):
        buckets = buckets_of(held)
        docs, places, sizes = sent_columns(held, "docs", "places", "sizes")
        at = shard_repeats(np.frombuffer(b"".join(r["bytes"] for r in held), np.uint8), sizes, docs)
        begins = np.cumsum(sizes) - sizes
        piece = np.searchsorted(begins, at, side="right") - 1
        start = places[piece] + at - begins[piece]
        return sent_batch(ranges_of(buckets[piece], docs[piece], start, start + LENGTH))

    def equal(held):
        buckets = buckets_of(held)
        keys, hashes, docs, places = sent_columns(held, "keys", "hashes", "docs", "places")
        order = np.lexsort((docs, hashes, keys))
        _, _, docs, places, gone = repeated_strings(keys, hashes, docs, places)
        return sent_batch(ranges_of(buckets[order][gone], docs[gone], places[gone], places[gone] + LENGTH))

    def run(batches):
        at, held, whole = None, [], []
        for batch in batches:
            known = batch.filter(batch.column(0).is_null())
            if known.num_rows:
                yield known
            for row in sent_rows(batch):
                if row["shard"] != at:
                    if held:
                        yield ranges(held)
                    if whole:
                        yield equal(whole)
                    held, whole = [], []
                at = row["shard"]
                (held if row["keys"] is None else whole).append(row)
        if held:
            yield ranges(held)
        if whole:
            yield equal(whole)

    return by_shard(sent, parts).mapInArrow(tidy(run), SENT_DDL)


def bucketed(documents: DataFrame, ranges: int) -> DataFrame:
    """doc_id, id, text and bucket of every document, and for every bucket one further row, its ``lead``."""
    doc_id = F.col("doc_id").cast("long")
    texts = documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(int(NULL_ID))).alias("id"), F.col("text").cast("string"))
    texts = texts.withColumns({"bucket": bucket_of(ranges), "lead": F.lit(False)})
    leads = documents.sparkSession.range(BUCKETS * ranges).withColumns({"bucket": F.col("id").cast("int"), "lead": F.lit(True)})
    leads = leads.withColumns({"doc_id": F.lit(None).cast("long"), "id": F.lit(int(NULL_ID)), "text": F.lit(None).cast("string")})
    return texts.unionByName(leads).repartition(ranges, "bucket")


def answered(texts: DataFrame, *answers: DataFrame) -> DataFrame:
    """``texts`` by bucket, the leads first, which alone get the columns of ``answers`` (one row per bucket)."""
    for answer in answers:
        own = answer.withColumnRenamed("bucket", "own").hint("shuffle_hash")
        texts = texts.join(own, (F.col("bucket") == F.col("own")) & F.col("lead"), "left").drop("own")
    return texts.sortWithinPartitions("bucket", F.col("lead").desc())


def cut_out(texts: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with ``keep_text`` also kept) of every document.

    The leads of ``texts`` have the ranges to remove, in several rows of ``first`` and ``second``.
    """

    def run(batches):
        none = [np.empty(0, np.int64)] * 3
        at, spans = None, none
        for batch in batches:
            rows = [[], [], [], [], []] + [[]] * keep_text
            given = [batch.column(c) for c in ("first", "second")]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "id", "bucket", "lead")]
            for k, (doc_id, id, bucket, lead, text) in enumerate(zip(*columns, text_bytes(batch.column("text")))):
                if bucket != at:
                    at, spans = bucket, none
                if lead:
                    found = [r for c in given for r in c[k].as_py() or ()]
                    # a row's ranges are joined, those of several rows not yet
                    joined = ranges_of(np.zeros(len(b"".join(r["docs"] for r in found)) // 8, np.int32), *sent_columns(found, "docs", "starts", "ends"))
                    spans = sent_columns(joined, "docs", "starts", "ends")
                    continue
                a, b = np.searchsorted(spans[0], id, "left"), np.searchsorted(spans[0], id, "right")
                kept, end = [], 0
                for s, e in zip(spans[1][a:b].tolist(), spans[2][a:b].tolist()):
                    kept.append(text[end:s])
                    end = e
                kept = b"".join([*kept, text[end:]])
                for column, value in zip(rows, (doc_id, len(text), len(text) - len(kept), int(b - a), hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    chosen = texts.select("doc_id", "id", "text", "bucket", "lead", "first", "second")
    return chosen.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def remove_repeats(documents: DataFrame, keep_text: bool = False) -> DataFrame:
    """The measures, and with ``keep_text`` the bytes, of every document without its repeated strings.

    The texts are shuffled by bucket once: all steps read the same exchange. So do the two readers of what the
    piece hashes settle, for which neither may leave out a row or column before it.
    """
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(partitions(documents.sparkSession), -(-size // RANGE))
    texts = bucketed(documents, n)
    keys = shared_grams(texts, n).groupBy("bucket").agg(F.collect_list("keys").alias("keys"))
    hashed = settled(piece_hashes(answered(texts, keys), n), n, OFTEN).repartition(n, "bucket").groupBy("bucket")
    row = F.struct(*[c for c in SENT if c != "bucket"])
    asked = hashed.agg(F.collect_list(F.when(F.col("keys").isNotNull(), row)).alias("asked"))
    second = repeated_ranges(pieces(answered(texts, asked), max(n, -(-MOST_PIECES * size // SHARD)), n), n)
    first = hashed.agg(F.collect_list(F.when(F.col("starts").isNotNull(), row)).alias("first"))
    second = second.groupBy("bucket").agg(F.collect_list(F.struct("docs", "starts", "ends")).alias("second"))
    return cut_out(answered(texts, first, second), keep_text)
