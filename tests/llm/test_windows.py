import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pulsegrid.llm import windows
from pulsegrid.llm.queries import QUERIES
from pulsegrid.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path(windows.TOKENIZER))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


def padding(rows, capacity):
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id] and r.length > 0
        filled[r.sequence_id] += r.length
    assert max(filled.values(), default=0) <= capacity
    return sum(capacity - n for n in filled.values() if n & (n - 1))


def test_best_fit_decreasing_as_one_by_one():
    draw = random.Random(4)
    for _ in range(150):
        capacity, counts = draw.choice([16, 17, 64, 100]), defaultdict(int)
        for _ in range(draw.randint(0, 80)):
            counts[draw.randint(1, capacity)] += 1
        bins = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fits = [b for b in bins if sum(b) + length <= capacity]
                max(fits, key=sum).append(length) if fits else bins.append([length])
        runs, gaps, n = windows.best_fit(counts, capacity)
        filled, ranks = defaultdict(int), defaultdict(list)
        for r in runs:
            ranks[r.length] += range(r.rank, r.rank + r.n)
            for k in range(r.n):
                filled[r.window + k] += r.length
        assert sorted(filled.values()) == sorted(map(sum, bins)) and n == len(bins)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: [*range(v)] for k, v in counts.items()}
        assert sum(g.size * g.n for g in gaps) == n * capacity - sum(filled.values())


def test_plan_fills_all_gaps_where_short_tails_suffice():
    draw = random.Random(6)
    for _ in range(200):
        counts = defaultdict(int)
        for _ in range(draw.randint(1, 60)):
            counts[draw.randint(1, 64)] += 1
        made = windows.plan(counts, 64, draw.choice([0, 4, 16]))
        held = sum((counts[k] - first) * k for k, first in made.held.items())
        assert held <= sum(g.size * g.n for g in made.gaps)
        everything = windows.plan(counts, 64, 64)
        assert sum(g.size * g.n for g in everything.gaps) == sum((counts[k] - first) * k for k, first in everything.held.items())


def test_encoder_equals_the_library(tokenizer, texts):
    encode = windows.WordEncoder(tokenizer_path(windows.TOKENIZER))
    more = ["", " \n\t", "Don't  'S I'll 12³ ÄÖß×÷ naïve_x a<|endoftext|>b <|startoftext|>", "İstanbul ſ ŉ", "日本 語​x", "é É́", "it's''s'sS'", "\x0b\x0c \x1f", "x" * 5000]
    for text in [*texts.values(), *more]:
        assert encode.ids(text) == ids_of(tokenizer, text)[:-1].tobytes(), text[:80]


def test_query_against_brute_force(spark, texts, tokenizer):
    rows = QUERIES["op11_windows"](spark, SF).collect()
    pieces = defaultdict(list)
    for r in rows:
        own = ids_of(tokenizer, texts[r.doc_id])
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(own)
        pieces[r.doc_id].append((r.start, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(ids_of(tokenizer, texts[doc_id]))
    assert padding(rows, windows.WINDOW) < 0.005 * sum(r.length for r in rows)


def test_longer_tails_fill_the_gaps_of_a_small_table(documents):
    assert padding(windows.place_documents(documents, sand=windows.WINDOW).collect(), windows.WINDOW) == 0


def test_windows_hold_the_ids(documents, tokenizer, texts):
    whole = {r.sequence_id: r for r in windows.windows(documents).collect()}
    assert sum(r.n_ids for r in whole.values()) == sum(len(ids_of(tokenizer, t)) for t in texts.values())
    for r in windows.place_documents(documents).collect():
        own = whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert len(own) == 4 * r.length and len(whole[r.sequence_id].ids) == 4 * whole[r.sequence_id].n_ids


@pytest.mark.parametrize("capacity,sand", [(2048, 256), (37, 0), (37, 20)])
def test_odd_rows(odd, tokenizer, capacity, sand):
    rows = windows.place_documents(odd, capacity=capacity, sand=sand).collect()
    total = sum(len(ids_of(tokenizer, r.text)) for r in odd.collect())
    assert sum(r.length for r in rows) == total
    padding(rows, capacity)


def test_empty_table(empty):
    assert windows.place_documents(empty).collect() == []
