"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer.

The composition ``V o E o V`` accepts the pairs of words that differ by exactly one inserted, deleted or replaced
code point (``V``: minimised acyclic acceptor, ``E``: copies, makes one edit, copies). It is enumerated per
partition of its initial state. While ``E`` has only copied, both sides of ``V`` are in one state, so a partition
is named by where the edit may lie: for a pair whose shorter word has ``size`` code points and whose first
difference lies in [low, high), both words share the first ``low`` code points and the last ``size - high``. Words
that share these form the acceptor of one partition, and each pair belongs to exactly one. Every word starts in
four partitions (as the shorter or as the longer word, difference in the first or the second half). A partition of
more than ``MOST`` words is split at the middle of its interval, as often as it takes, before any is read; one of
a single position cannot be split and has few words, which differ in one or two code points.

Words are maximal runs of letters, lower-cased in A-Z only. Null texts have none; texts are read whole, of any
length. Repeated rows count as often as they occur; ties in n go to the word smallest in code-point order. An
empty table gives an empty result. Null ids are empty in checksums. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import tidy, written

#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Words of one partition that are composed in one go.
MOST = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimised acyclic acceptor of sorted distinct words.

    Per state: ``final``, ``arcs`` (code point to state), ``skip`` (code point to the number of words from the state
    that precede those by this arc) and ``count`` (words from the state). Skips along a path add up to a word's index.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.skip: list[dict[str, int]] = []
        self.count: list[int] = []
        self.known: dict[tuple, int] = {}
        path: list[tuple[list, str | None]] = [([False, {}], None)]  # open states of the last word and the arc into each
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, same)
            path += [([False, {}], letter) for letter in word[same:]]
            path[-1][0][0] = True
            last = word
        self._close(path, 0)
        self.start = self._state(*path[0][0])

    def _close(self, path: list, keep: int) -> None:
        while len(path) > keep + 1:
            state, letter = path.pop()
            path[-1][0][1][letter] = self._state(*state)

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        """The one state with this right language: equal finality and equal arcs."""
        key = (final, tuple(arcs.items()))
        if key not in self.known:
            self.known[key] = len(self.final)
            skip, count = {}, int(final)
            for letter, then in arcs.items():
                skip[letter] = count
                count += self.count[then]
            self.final.append(final)
            self.arcs.append(arcs)
            self.skip.append(skip)
            self.count.append(count)
        return self.known[key]


class Composition:
    """``V o E o V`` over one acceptor: pairs of words that differ by one edit, each once, by its first difference."""

    def __init__(self, acceptor: Acceptor):
        self.acceptor = acceptor
        self.known: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _shared(self, a: int, b: int, without: str | None = None) -> list[tuple[int, int]]:
        v = self.acceptor
        found = [(0, 0)] if v.final[a] and v.final[b] else []
        there, skip_a, skip_b = v.arcs[b], v.skip[a], v.skip[b]
        for letter, then in v.arcs[a].items():
            if letter in there and letter != without:
                x, y = skip_a[letter], skip_b[letter]
                found += [(x + i, y + k) for i, k in self._common(then, there[letter])]
        return found

    def _common(self, a: int, b: int) -> list[tuple[int, int]]:
        """The words accepted from both states, which is what follows an edit, by their index from each."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.known:
                todo.pop()
                continue
            if x == y:
                self.known[x, y] = [(k, k) for k in range(self.acceptor.count[x])]
                continue
            there = self.acceptor.arcs[y]
            missing = [(then, there[c]) for c, then in self.acceptor.arcs[x].items() if c in there and (then, there[c]) not in self.known]
            if missing:
                todo += missing
            else:
                self.known[x, y] = self._shared(x, y)
        return self.known[a, b]

    def pairs(self) -> Iterator[tuple[int, int, int]]:
        """(index of a word, index of the other, first difference)."""
        v = self.acceptor
        stack = [(v.start, 0, 0)]
        while stack:
            state, before, at = stack.pop()
            skip, arcs = v.skip[state], [*v.arcs[state].items()]
            for k, (letter, then) in enumerate(arcs):
                x = before + skip[letter]
                # replaced: this letter against each later one
                for other, there in arcs[k + 1 :]:
                    y = before + skip[other]
                    for i, j in self._common(then, there):
                        yield x + i, y + j, at
                # inserted: the shorter word goes on from this state, and not with the inserted letter
                for i, j in self._shared(state, then, letter):
                    yield before + i, x + j, at
                stack.append((then, x, at + 1))


def runs(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``run``: lower-cased runs of at least ``LEAST_LENGTH`` letters; shorter ones cannot become words."""
    found = F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]{%d,})" % LEAST_LENGTH), F.lit(1))
    texts = documents.select(F.col("doc_id").cast("string"), F.translate(F.col("text").cast("string"), UPPER, LOWER).alias("text"))
    return texts.select("doc_id", F.explode(found).alias("run"))


def misspelt(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point, chosen by a checksum, where 97 divides that checksum of ``<doc_id>:<run>``."""
    sum32 = F.crc32(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(":"), run).cast("binary"))
    at = (sum32 % F.char_length(run)).cast("int")
    return F.when(sum32 % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame) -> DataFrame:
    """The vocabulary of a column ``word``: word, n."""
    long = words.where(F.char_length("word") >= LEAST_LENGTH)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


KEY = ["size", "low", "high", "head", "tail"]


def _placed(words: DataFrame, size: Column, low: Column, high: Column) -> DataFrame:
    """``words`` with the key of their partition: ``size`` is the length of the shorter word of a pair."""
    length = F.char_length("word")
    keyed = words.withColumns({"size": size, "low": low, "high": high})
    head = F.substring("word", F.lit(1), F.col("low"))
    rest = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    return keyed.withColumns({"head": head, "tail": F.substring(F.col("word"), length - rest + 1, rest)})


def _halves(low: Column, middle: Column, high: Column) -> Column:
    return F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in ((low, middle), (middle, high))))


def partitions_of(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """Each word in its partitions: word, n and ``KEY``; no partition that can be split has more than ``most`` words.

    ``high`` is ``size + 1`` in the last interval, since a letter may be added at the end.
    """
    length, half = F.char_length("word"), F.expr("_size div 2").cast("int")
    sized = vocabulary.withColumn("_size", F.explode(F.array(length, length - 1)))
    first = sized.select("word", "n", "_size", F.inline(_halves(F.lit(0), half, F.col("_size") + 1)).alias("a", "b"))
    placed = _placed(first, F.col("_size"), F.col("a"), F.col("b"))
    placed = written(placed.select("word", "n", *KEY), "spelling")
    done = []
    while True:
        large = placed.groupBy(*KEY).count().where(f"count > {most} AND high - low > 1").drop("count")
        large = written(large, "spelling-large")
        if large.isEmpty():
            return _union([*done, placed])
        done.append(placed.join(large, KEY, "left_anti"))
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        split = placed.join(large, KEY, "left_semi").select("word", "n", "size", F.inline(_halves(F.col("low"), middle, F.col("high"))).alias("a", "b"))
        placed = _placed(split, F.col("size"), F.col("a"), F.col("b"))
        placed = written(placed.select("word", "n", *KEY), "spelling")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


NEAR = "word string, n long, n_near long, form_n long, form string"


def composed(batches) -> Iterator[pa.RecordBatch]:
    """Per word and partition: its near words, and the best of them. Rows come sorted by partition and word."""
    names, kinds = [c.split()[0] for c in NEAR.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("part", "word", "n", *KEY)))

    def near(own: list[tuple]) -> Iterator[tuple]:
        size, low, high = own[0][3:6]
        number, best = [0] * len(own), [None] * len(own)
        for i, k, at in Composition(Acceptor([w[1][low:] for w in own])).pairs():
            # the pair's own size and first difference choose the one partition that counts it
            if min(len(own[i][1]), len(own[k][1])) != size or low + at >= high:
                continue
            for one, other in ((i, k), (k, i)):
                offer = (-own[other][2], own[other][1])
                number[one] += 1
                best[one] = offer if best[one] is None else min(best[one], offer)
        for (_, word, n, *_), n_near, offer in zip(own, number, best):
            if n_near:
                yield word, n, n_near, -offer[0], offer[1]

    held = []
    for _, group in groupby(rows(), key=itemgetter(0, 3, 4, 5, 6, 7)):
        own = [*group]
        if len(own) > 1:
            held += near(own)
        if len(held) >= MOST:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """``NEAR`` for the words that have near ones: their number, and the most frequent one with its n."""
    placed = partitions_of(vocabulary, most).withColumn("part", F.xxhash64(*KEY))
    rows = placed.repartition("part").sortWithinPartitions("part", *KEY, "word")
    found = rows.mapInArrow(tidy(composed), NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of each word's forms (``form`` null: the word itself).

    Every step follows twice as many forms; a form occurs ``RATIO`` times as often, so chains are short.
    """
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        roots = written(roots, "roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next")).where("root != next")
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def variant_groups(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of a vocabulary (word, n)."""
    near = near_words(vocabulary, most).where("n_near > 0").drop("n")
    rows = vocabulary.join(near, "word", "left")
    more = F.col("form_n") >= RATIO * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(more, F.col("form")).alias("form"), F.when(more, F.col("form_n")).alias("form_n"))
    rows = written(rows, "forms")
    return rows.join(with_roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def document_variants(documents: DataFrame) -> DataFrame:
    """Spelling variants among the words of all documents, some of them misspelt on purpose first."""
    words = runs(documents).select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return variant_groups(written(counted(words), "vocabulary"))
