import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from benchset.check import compare, connect
from pulsegrid.llm import embeddings, exact, induced, near, queries, repeats
from pulsegrid.llm.common import components
from pulsegrid.llm.induced import TupleSorter, suffixes


def rows_of(df):
    return df.collect()


def test_exact_groups_equal_sql(spark, duck, documents):
    got = {r.doc_id: tuple(r) for r in exact.exact_groups(documents).collect()}
    result = duck.execute(queries.SQL["op4_exact_dedup"])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")]
    assert got == {r[order[0]]: tuple(r[k] for k in order) for r in result.fetchall()}


def test_exact_odd_rows(odd, empty):
    got = exact.exact_groups(odd).collect()
    assert len(got) == odd.count()
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    assert all(sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} for group in by_text.values())
    same = by_text[hashlib.sha256(b"same text here").hexdigest()]
    assert {r.keep_id for r in same} == {6} and len(same) == 3
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(by_text)
    assert exact.exact_groups(empty).count() == 0 and exact.drop_copies(empty).count() == 0


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 52, 3000)
    prints = np.concatenate([prints, prints[:500], prints[:100]])
    parts = [exact.CountingQuotientFilter.of(x) for x in np.array_split(rng.permutation(prints), 7)]
    whole = exact.CountingQuotientFilter.of(np.empty(0, np.int64))
    for p in parts:
        for _, piece in p.ranges(5):
            whole = whole.merged(exact.CountingQuotientFilter.from_bytes(piece.to_bytes()))
    values, counts = np.unique(prints, return_counts=True)
    assert (whole.slots << exact.REMAINDER | whole.remainders.astype(np.int64)).tolist() == values.tolist()
    assert whole.counts.tolist() == counts.tolist()
    assert sorted(whole.repeated()) == sorted(values[counts > 1])


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "fingerprint", lambda t: len(t))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "AB")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact.exact_groups(df).collect()) == [(1, 3, False), (2, 2, True), (3, 3, True)]


def shingle_groups(rows, size, percent):
    """Brute force over all pairs: set size and smallest doc_id of the component of each row."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k in range(len(rows)):
        low[find(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in low[find(k)] if i is not None), default=None)) for k in range(len(rows))]


def planted(seed, groups=12):
    """Bases with copies around the threshold, chains, tiny sets and repeated rows."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 20, 60, 75, 200]))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += [rng.choice(vocabulary) for _ in range(rng.randint(1, 3))]
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return [(k * 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed, size, percent", [(1, 3, 85), (2, 5, 80)])
def test_near_groups_equal_brute_force(spark, seed, size, percent):
    rows = planted(seed)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_groups(rows, size, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_documents(documents, texts):
    got = near.near_groups(documents, 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_groups(list(texts.items()), 3, 85))


@pytest.mark.parametrize("name", ["op8_near_dedup", "op9_embedding_dedup"])
def test_linked_groups_equal_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.SQL[name]) is None


def test_sql_of_vectors_with_links(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    vectors = [(k, (centres[k % 20] + rng.normal(size=16) * 0.12).tolist()) for k in range(300)]
    odd = [(300, None), (301, [0.0] * 16), (302, [1.0, None]), (303, []), (304, [float("nan")] * 16), (305, vectors[0][1]), (306, [1.0]), (307, [2.0])]
    spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    name = "op9_embedding_dedup"
    assert compare(spark, con, str(tmp_path), name, queries.QUERIES[name], queries.SQL[name]) is None


def test_large_canopies_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    rows = planted(5, 6)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(shingle_groups(rows, 3, 85))


def test_near_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = near.near_groups(odd, 3, 85).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(shingle_groups(rows, 3, 85), key=key)
    kept = near.drop_near_copies(odd, 3, 85)
    assert kept.columns == odd.columns and kept.count() == len({(i if n else (i, k)) for k, (_, n, i) in enumerate(shingle_groups(rows, 3, 85))})
    assert near.near_groups(empty).count() == 0 and near.drop_near_copies(empty).count() == 0


def test_near_copies_of_repeated_ids(spark):
    """Rows that share doc_id and text: the least stays. Ids that repeat with other texts stand for themselves."""
    text = "one two three four five six seven"
    rows = [(4, text, "b", 2), (4, text, "b", 1), (4, text, "a", 9), (4, "quite another text", "c", 0), (9, text, "a", 0), (4, "", "x", 1), (4, "", "x", 1), (4, None, "x", 1)]
    kept = near.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, mark string, row int"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[2], rows[3], rows[5], rows[6], rows[7]], key=repr)


def test_estimates_follow_the_true_similarity():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.9):
        found = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 600).astype(np.uint64)
            n = int(600 * share)
            a, b = both[: n + (600 - n) // 2], np.concatenate([both[:n], both[n + (600 - n) // 2 :]])
            x, y = (near.sketch(np.unique(s), 2)[None, :] for s in (a, b))
            found.append(float(near.estimates(x, y)[0][0, 0]))
        assert abs(np.mean(found) - share) < 0.03


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    nodes = spark.range(0, 450).select("id")
    got = {r.id: r.component_id for r in components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(450))
    for _ in range(450):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root))


def cut_texts(rows, length=50):
    """Brute force: (n_bytes, n_removed, n_spans, kept_sha256) per row."""
    least = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(bool(x) and not (k and gone[k - 1]) for k, x in enumerate(gone))
        kept = bytes(b for b, x in zip(t, gone) if not x)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    rng, rows = random.Random(4), []
    base = "".join(rng.choice("ab") for _ in range(300))
    for k in range(200):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 150)))
        a = rng.randint(0, 200)
        rows.append((k, t + base[a : a + rng.randint(0, 100)] + "x" * rng.randint(0, 80) + t[:60]))
    rows += [(1000, None), (1001, ""), (1002, "é" * 100), (1003, "é" * 60), (1004, "\0" * 70), (1005, "\0" * 55), (1005, "\0" * 55)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in repeats.remove_repeats(df).collect()) == sorted(cut_texts([(i, (t or "").encode()) for i, t in rows]))


def test_repeats_of_documents_and_kept_text(documents, texts):
    got = repeats.remove_repeats(documents, keep_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(cut_texts([(i, t.encode()) for i, t in texts.items()]))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_long_texts_are_cut_into_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACE_BITS", 9)
    monkeypatch.setattr(repeats, "BATCH", 300)
    rng = random.Random(6)
    base = "".join(rng.choice("abcd") for _ in range(3000))
    texts = [base[:2000], "zz" + base[500:2900], base[1000:1400] * 3, "q" * 1000]
    got = [repeats.anchors([t.encode()]) for t in texts]
    for t, (_, _, first, last) in zip(texts, got):
        assert set(range(len(t) - 49)) <= {s for a, b in zip(first, last) for s in range(a, b + 1)}


def test_repeats_odd_rows(odd, empty):
    rows = [(repeats.NULL_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in odd.where("doc_id <> 7 OR doc_id IS NULL").collect()]
    got = repeats.remove_repeats(odd.where("doc_id <> 7 OR doc_id IS NULL")).collect()
    assert sorted((repeats.NULL_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(cut_texts(rows))
    assert repeats.remove_repeats(odd).count() == odd.count()
    assert repeats.remove_repeats(empty).count() == 0


def check_suffixes(text, sigma, depth, memory):
    found = list(suffixes(np.array(text, np.uint16), sigma, depth, memory))
    places = np.concatenate([p for p, _ in found]).tolist() if found else []
    prefix = np.concatenate([q for _, q in found]).tolist() if found else []
    assert sorted(places) == list(range(len(text)))
    key = lambda k: text[k : k + depth]
    for k in range(1, len(places)):
        a, b = key(places[k - 1]), key(places[k])
        assert a <= b
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[k] == n


@pytest.mark.parametrize("memory", [1 << 30, 200])
def test_suffix_order_in_memory_and_on_disk(memory):
    rng = random.Random(7)
    for _ in range(150):
        sigma = rng.choice([1, 2, 3, 10, 257])
        text = [rng.randrange(sigma) for _ in range(rng.randint(0, 120))]
        if text and rng.random() < 0.5:
            part = text[: rng.randint(1, len(text))]
            text = text + [0] + part + [0] + part
        check_suffixes(text, sigma, rng.choice([3, 10, 50]), memory)


def test_tuple_sorter_merges_runs_from_disk():
    rng = np.random.default_rng(8)
    sorter = TupleSorter(4_000)
    sorter.BLOCK = 64
    keys = rng.integers(0, 500, 5000)
    for part in np.array_split(np.arange(5000), 40):
        sorter.add(keys[part], part)
    found = list(sorter.sorted())
    got = np.concatenate([k for k, _ in found])
    places = np.concatenate([p for _, p in found])
    assert got.tolist() == sorted(keys.tolist()) and (keys[places] == got).all() and len(set(places.tolist())) == 5000


def vector_truth(rows, threshold=0.95):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = [(k, x / np.abs(x).max()) for k, x in ok]  # else squares of large components overflow
    links = np.zeros((len(rows), len(rows)), bool)
    for a, x in ok:
        for b, y in ok:
            if a != b and len(x) == len(y):
                links[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for a, b in np.argwhere(links):
            root[a] = root[b] = min(root[a], root[b])
    low = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return [(rows[k][0], int(links[k].sum()), low[root[k]]) for k in range(len(rows))]


def test_vector_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 5)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(25):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append([float(x) for x in base + rng.normal(size=16) * rng.choice([0, 0.02, 0.08])])
    rows += [[0.0] * 16, None, [], [float("nan")] * 16, [None] + [1.0] * 15, [1e300] * 16, [2e300] * 16, [1.0, 0.0], [1.0, 0.001]]
    rows = [(k, v) for k, v in enumerate(rows)] + [(None, rows[0])]
    got = embeddings.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda x: repr(x)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(vector_truth(rows), key=key)


def test_vectors_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = embeddings.vector_groups(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(vector_truth(rows))
    assert embeddings.vector_groups(df.limit(0)).count() == 0


def test_neighbour_lists_reach_the_wanted_recall(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(400, 32))
    rows = [(k, [float(x) for x in base[k % 400] + 0.1 * rng.normal(size=32)]) for k in range(1600)]
    vectors = embeddings.readable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    nodes = vectors.selectExpr("row AS id", "v", "1 AS w")
    graph = embeddings.neighbour_graph(nodes, 0.95)
    assert embeddings.audit(graph, nodes, 0.95) >= 0.9


def test_links_between_groups_of_saturated_lists(spark):
    rng = np.random.default_rng(11)
    turn, rows = np.arccos(0.96), []
    for far in (0, turn):
        centre = np.zeros(24)
        centre[:2] = np.cos(far), np.sin(far)
        for _ in range(14):  # 0.999 within a group, 0.96 across
            x = centre + np.append([0, 0], rng.normal(size=22)) * 0.0316 / np.sqrt(44)
            rows.append((len(rows), [float(c) for c in x]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.vector_groups(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(vector_truth(rows))
    assert [r.vec_id for r in got if r.kept] == [0]
    nodes = embeddings.readable(df).selectExpr("row AS id", "v", "1 AS w")
    graph, state = embeddings.grouped_graph(nodes, 0.95)
    assert embeddings.audit(graph, nodes, 0.95, state) == 1.0
    apart = nodes.selectExpr("id", "id AS component_id")
    assert embeddings.audit(graph, nodes, 0.95, apart) < 0.9


def test_lists_are_enlarged_until_the_audit_is_met(spark, monkeypatch):
    """With one order, blocks of four and lists of two the first round misses most links."""
    for name, value in (("K", 2), ("LEAF", 4), ("TREES", 1), ("ROUNDS", 1)):
        monkeypatch.setattr(embeddings, name, value)
    turns, first = [], embeddings.first_lists
    monkeypatch.setattr(embeddings, "first_lists", lambda nodes, k, leaf, turn=0: turns.append((k, leaf, turn)) or first(nodes, k, leaf, turn))
    rng = np.random.default_rng(13)
    base = rng.normal(size=(60, 24))
    rows = [(k, [float(x) for x in base[k % 60] + 0.1 * rng.normal(size=24)]) for k in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embeddings.vector_groups(df).collect()
    truth = {d: (n, c) for d, n, c in vector_truth(rows)}
    found, true = sum(r.n_links for r in got), sum(n for n, _ in truth.values())
    assert turns[0] == (2, 4, 0) and turns[1] == (4, 8, 1) and 0.99 * true <= found <= true
    assert all(r.n_links <= truth[r.vec_id][0] for r in got)


def test_strings_of_a_common_gram_are_dealt_out(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    ends = [word(60) for _ in range(5)]
    # one of its 16-byte windows is the lowest of many strings; some ends repeat, with other beginnings
    rows = [(k, word(30) + "The common phrase, again and again" + (rng.choice(ends) if k % 3 else word(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(repeats, "OFTEN", 20, raising=False)
    seen, real = [], repeats.repeated_ranges
    monkeypatch.setattr(repeats, "repeated_ranges", lambda sent, *more: seen.append(sent) or real(sent, *more))
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df, keep_text=True).collect()}
    first, want = {}, {}
    for k, t in rows:
        for a in range(len(t) - 49):
            first.setdefault(t[a : a + 50], k)
    for k, t in rows:
        gone = {c for a in range(len(t) - 49) if first[t[a : a + 50]] < k for c in range(a, a + 50)}
        want[k] = "".join(c for i, c in enumerate(t) if i not in gone).encode()
    assert got == want and any(len(want[k]) < len(t) for k, t in rows)
    load = defaultdict(int)
    for r in seen[0].where("shard IS NOT NULL").collect():
        load[r.shard] += sum(len(x) for x in (r.keys, r.hashes, r.docs, r.places, r.bytes) if x)
    assert max(load.values()) < 0.3 * sum(load.values())
    docs = [len(r.docs) // 8 for r in seen[0].where("bytes IS NOT NULL").collect()]
    assert max(docs, default=0) < 40


def test_ranges_of_grams_have_even_sizes(spark, monkeypatch):
    rng = random.Random(13)
    text = ["".join(rng.choice("abcdefghijkl ") for _ in range(20_000)) for _ in range(4)]
    rows = [(k, text[k % 4]) for k in range(8)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8, "id")
    load = defaultdict(int)
    for r in repeats.shared_grams(df, 48).selectExpr("spark_partition_id() AS p", "length(keys) AS n").collect():
        load[r.p] += r.n
    assert max(load.values()) < 0.2 * sum(load.values())
    keys = [(k, t, [np.unique(repeats.anchors([t.encode()])[0]).tobytes()], k) for k, t in rows]
    hashed = repeats.piece_hashes(spark.createDataFrame(keys, "id long, text string, keys array<binary>, doc_id long"), 48)
    load = defaultdict(int)
    for r in hashed.where("shard IS NOT NULL").collect():
        load[r.shard] += len(r.keys)
    assert max(load.values()) < 0.06 * sum(load.values())
    # more ranges than shuffle partitions where the texts are large
    seen, real = [], repeats.piece_hashes
    monkeypatch.setattr(repeats, "RANGE", 4096, raising=False)
    monkeypatch.setattr(repeats, "piece_hashes", lambda texts, ranges: seen.append(ranges) or real(texts, ranges))
    out = repeats.remove_repeats(df.withColumnRenamed("id", "doc_id")).collect()
    assert seen == [40] and sorted(r.n_removed for r in out) == [0] * 4 + [20_000] * 4


def test_rows_about_documents_do_not_follow_their_number(spark, monkeypatch):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [word(400) for _ in range(20)]
    rows = [(k if k % 5 else None, word(40) + base[k % 20] + word(rng.randint(0, 9)) + base[k % 7][:200]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    # one row for each range and bucket, not for each document and range
    shared = repeats.shared_grams(df.selectExpr("coalesce(doc_id, -1) AS id", "text"), 4)
    assert 0 < shared.count() <= 4 * 4 * repeats.BUCKETS
    seen, real = [], repeats.settled
    monkeypatch.setattr(repeats, "partitions", lambda spark: 4)
    monkeypatch.setattr(repeats, "settled", lambda sent, *more: seen.append(real(sent, *more)) or seen[-1])
    got = repeats.remove_repeats(df).collect()
    assert 0 < seen[0].where("keys IS NOT NULL").count() <= 4 * 4 * repeats.BUCKETS
    brute = cut_texts([(repeats.NULL_ID if i is None else i, t.encode()) for i, t in rows])
    assert sorted((repeats.NULL_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in got) == sorted(brute)


def test_texts_of_few_syllables_do_not_meet_by_chance(spark, monkeypatch):
    """What is left to the sort follows what is repeated, not how many texts of the same syllables there are."""
    rng = random.Random(17)
    parts = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(12)]
    rows = [(k, "".join(rng.choice(parts) for _ in range(700))) for k in range(200)]
    rows += [(1000 + k, rows[k][1][:300] + rows[k + 50][1][90:400]) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, real = [], repeats.settled
    monkeypatch.setattr(repeats, "settled", lambda sent, *more: seen.append(real(sent, *more)) or seen[-1])
    got = repeats.remove_repeats(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(cut_texts([(k, t.encode()) for k, t in rows]))
    left = sum(sum(r.sizes) for r in seen[0].where("keys IS NOT NULL").collect())
    assert 0 < left < 0.03 * sum(len(t) for _, t in rows)


def test_grams_known_by_half_of_their_hash(spark, monkeypatch):
    """Grams that differ in the other half only, or not at all in what is sent, add pieces but change no result."""
    monkeypatch.setattr(repeats, "halves", lambda keys: (keys & np.uint64(15)).astype(np.uint32))
    rng = random.Random(18)
    rows = [(k if k % 7 else None, "".join(rng.choice("abcdefgh ") for _ in range(400))) for k in range(40)]
    rows += [(50 + k, rows[k][1][20:99] + rows[k + 9][1][:70 + k]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(repeats.NULL_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in repeats.remove_repeats(df).collect()]
    assert sorted(got) == sorted(cut_texts([(repeats.NULL_ID if k is None else k, t.encode()) for k, t in rows]))


def test_common_prefixes_and_sorted_tuples_equal_plain_ones():
    rng = np.random.default_rng(15)
    text = np.append(rng.integers(0, 2, 3000), np.zeros(60, int)).astype(np.uint16) * 300
    a, b = rng.integers(0, 3000, (2, 2000))
    for depth in (2, 5, 50):
        want = [next((k for k in range(depth) if text[x + k] != text[y + k]), depth) for x, y in zip(a, b)]
        assert induced.common_prefix(text, a, b, depth).tolist() == want
    values = rng.integers(0, 50, 700).astype(np.uint8)
    first = rng.integers(0, 700, 900)
    last = np.minimum(first + rng.integers(0, 600, 900), 699)
    assert induced.RangeMinimum(values).least(first, last).tolist() == [values[x : y + 1].min() for x, y in zip(first, last)]
    for most in (50, 1 << 62):  # keys that fit in one number with their positions, and keys that don't
        keys, sorter = rng.integers(0, most, 5000), TupleSorter(20_000)
        for k in range(0, 5000, 1000):
            sorter.add(keys[k : k + 1000], np.arange(k, k + 1000))
        found = [np.concatenate(x) for x in zip(*sorter.sorted())]
        assert np.array_equal(found[0], np.sort(keys)) and np.array_equal(found[0], keys[found[1]]) and len(set(found[1].tolist())) == 5000
