import random
import re
import zlib
from collections import Counter

import pytest

from benchset.check import compare, connect
from pulsegrid.llm import spelling
from pulsegrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(counts):
    """word: (form, root, n, n_near, form_n)."""
    forms, numbers = {}, {}
    for word, n in counts.items():
        own = [w for w in counts if abs(len(w) - len(word)) < 2 and near(w, word)]
        best = min(own, key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best is not None and counts[best] >= 2 * n else None
        numbers[word] = len(own)

    def root(word):
        return word if forms[word] is None else root(forms[word])

    return {w: (forms[w], root(w), n, numbers[w], counts.get(forms[w])) for w, n in counts.items()}


def vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_acceptor_is_minimal_and_counts_words():
    words = sorted({"".join(p) for p in ("tap", "taps", "top", "tops", "stop", "stops")})
    v = spelling.Acceptor(words)
    assert len(v.final) == 7 and v.count[v.start] == len(words)  # what follows ta, to and sto is held once
    at = []
    for word in words:
        state, index = v.start, 0
        for letter in word:
            state, index = v.arcs[state][letter], index + v.skip[state][letter]
        at.append(index)
        assert v.final[state]
    assert at == [*range(len(words))]


def test_composition_gives_every_pair_once():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(0, 6))) for _ in range(80)})
    found = [(words[i], words[k]) for i, k, _ in spelling.Composition(spelling.Acceptor(words)).pairs()]
    assert len(found) == len(set(map(frozenset, found)))
    assert set(map(frozenset, found)) == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


@pytest.mark.parametrize("most", [2, 7, spelling.MOST])
def test_split_partitions_lose_nothing(frame, most):
    """Words that nearly all share a partition, which a small bound has to split again and again."""
    draw = random.Random(most)
    words = {"common" + "".join(draw.choice("abé") for _ in range(draw.randint(0, 5))) for _ in range(150)} | {"x" * k for k in range(5, 12)}
    counts = {w: draw.randint(3, 30) for w in words}
    rows = frame(list(counts.items()), "word string, n long")
    assert by_word(spelling.variant_groups(rows, most)) == expected(counts)
    sizes = spelling.partitions_of(rows, most).where("high - low > 1").groupBy(*spelling.KEY).count()
    assert sizes.where(f"count > {most}").isEmpty()


def test_query_against_brute_force(spark, documents):
    counts = vocabulary((r.doc_id, r.text) for r in documents.collect())
    found = by_word(QUERIES["op12_spelling"](spark, SF))
    assert {w: v[2] for w, v in found.items()} == counts
    some = random.Random(1).sample(sorted(counts), 150)
    for word in some:
        own = [w for w in counts if abs(len(w) - len(word)) < 2 and near(w, word)]
        best = min(own, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[word] else None
        assert (found[word][0], *found[word][3:]) == (form, len(own), counts.get(form))
    assert compare(spark, connect(SF), SF, "op12", QUERIES["op12_spelling"], SQL["op12_spelling"]) is None


def test_odd_rows(odd, frame):
    assert by_word(spelling.document_variants(odd)) == expected(vocabulary((r.doc_id, r.text) for r in odd.collect()))
    long, base = "Ä" * 3000, "weather"
    rows = [(k, f"{long} {long}é {base} {base}s, {base} WEATHER×weather{chr(0xE9)}") for k in range(4)] + [(None, base), (9, None), (9, "")]
    wide = frame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, word string, run string, n int")
    assert by_word(spelling.document_variants(wide)) == expected(vocabulary(rows))


def test_empty_table(empty):
    assert spelling.document_variants(empty).collect() == []
