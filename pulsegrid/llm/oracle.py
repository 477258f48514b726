"""SQL that states the same results as some of the operators, for DuckDB over the same tables."""

from __future__ import annotations

#: The 256 steps of the CRC-32 of one byte, from its polynomial, and the sum of a list of bytes.
CRC_STEPS = """
    steps AS (
        SELECT list(step ORDER BY i) AS t FROM (
            SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c // 2) ELSE c // 2 END, i::UBIGINT) AS step
            FROM range(256) r(i)
        )
    )"""


def crc32(data: str) -> str:
    """Checksum of a list of bytes (UBIGINT[]); table ``steps`` must be in scope."""
    return f"xor(list_reduce({data}, lambda c, b: xor(c // 256, t[(xor(c, b) % 256)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)"


def utf8(text: str) -> str:
    """The UTF-8 bytes of a text whose code points are below 2048."""
    points = f"list_transform(string_split({text}, ''), lambda x: ord(x))"
    return f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END))::UBIGINT[]"


SPELLING = f"""
    WITH RECURSIVE {CRC_STEPS},
    texts AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS run FROM texts),
    sums AS (SELECT run, {crc32(utf8("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM runs, steps WHERE length(run) >= 5),
    spelt AS (
        SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word
        FROM sums
    ),
    words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
    holes AS (
        SELECT word, n, i, substring(word, 1, i) || '_' || substring(word, i + 2) AS masked, substring(word, 1, i) || substring(word, i + 2) AS shorter
        FROM words, unnest(range(length(word))) u(i)
    ),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.masked = b.masked AND a.word <> b.word
        UNION
        SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
        UNION
        SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word
    ),
    ranked AS (
        SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place
        FROM pairs
    ),
    forms AS (
        SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
        FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
    ),
    chains AS (
        SELECT word, word AS root FROM forms
        UNION ALL
        SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
    ),
    ends AS (SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
    SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e USING (word)
"""

CONVERSATIONS = f"""
    WITH RECURSIVE {CRC_STEPS},
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
    kinds AS (
        SELECT g.*, {crc32(utf8("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))} % 20 AS kind FROM given g, steps
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM kinds, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) c(copy) WHERE kind <> 0
    ),
    numbered AS (
        SELECT conv_id, turn, role, text, left(role, 1) AS initial,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
               count(*) OVER (PARTITION BY conv_id) AS size
        FROM damaged
    ),
    faulty AS (
        SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before,
               CASE WHEN kept = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2
                    WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
        FROM numbered
    ),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id
    ),
    paths AS (
        SELECT conv_id, 0::BIGINT AS place, k.last, k.cost::BIGINT AS cost, k.audit, k.lines
        FROM (SELECT DISTINCT conv_id FROM faulty),
             (VALUES ('n', 0, '', []::VARCHAR[]), ('u', 5, 'I', ['user:']), ('a', 10, 'II', ['user:', 'assistant:'])) k(last, cost, audit, lines)
        UNION ALL
        SELECT conv_id, place, last, best.cost, best.audit, best.lines FROM (
            SELECT conv_id, place, last, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
                SELECT conv_id, place, CASE WHEN k = 0 THEN last WHEN (k = 1) = (last = 'u') THEN 'a' ELSE 'u' END AS last,
                       cost + 5 * k AS cost, audit || repeat('I', k) AS audit,
                       lines || CASE WHEN k = 0 THEN []::VARCHAR[] WHEN last = 'u' THEN ['assistant:', 'user:'][1:k] ELSE ['user:', 'assistant:'][1:k] END AS lines
                FROM (
                    SELECT p.conv_id, f.place, e.letter, p.audit || e.letter AS audit,
                           p.cost + CASE e.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.letter <> 'D' AND f.fault = 3 THEN 5 ELSE 0 END AS cost,
                           CASE WHEN e.letter = 'D' THEN p.last WHEN e.letter = 'K' THEN f.initial WHEN p.last = 'u' THEN 'a' ELSE 'u' END AS last,
                           p.lines || CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text]
                                      ELSE [CASE WHEN p.last = 'u' THEN 'assistant:' ELSE 'user:' END || f.text] END AS lines
                    FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place + 1,
                         (VALUES ('D'), ('K'), ('R')) e(letter)
                    WHERE e.letter = 'D' OR (f.fault NOT IN (1, 2) AND CASE e.letter
                        WHEN 'K' THEN (p.last = 'n' AND f.initial = 's') OR f.initial = CASE WHEN p.last = 'u' THEN 'a' ELSE 'u' END
                        ELSE f.initial <> CASE WHEN p.last = 'u' THEN 'a' ELSE 'u' END END)
                ), unnest([0, 1, 2]) i(k)
            ) GROUP BY conv_id, place, last
        )
    ),
    solved AS (
        SELECT p.conv_id, min({{'cost': p.cost, 'audit': p.audit, 'lines': p.lines}}) AS best
        FROM paths p JOIN (SELECT DISTINCT conv_id, size FROM faulty) s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.size = p.place
        WHERE p.last IN ('n', 'a') GROUP BY p.conv_id
    )
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
           sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
    LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
"""

#: Links are looked for among sets that share one of their rarest shingles, as many as a similarity of 0.85 can miss, and one more.
NEAR = r"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ),
    held AS (
        SELECT DISTINCT doc_id, array_to_string(words[k:k + 2], ' ') AS shingle
        FROM worded, unnest(range(1, greatest(len(words) - 1, least(len(words) + 1, 2)))) u(k)
    ),
    common AS (SELECT shingle, count(*) AS df, row_number() OVER (ORDER BY count(*), shingle) AS s FROM held GROUP BY shingle),
    ranked AS (
        SELECT doc_id, s, df, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS place, count(*) OVER (PARTITION BY doc_id) AS n
        FROM held JOIN common USING (shingle)
    ),
    sets AS (SELECT doc_id, n, list(s ORDER BY s) AS items FROM ranked GROUP BY doc_id, n),
    heads AS (SELECT doc_id, s FROM ranked WHERE df > 1 AND 100 * (n - place + 1) >= 85 * n),
    candidates AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM heads a JOIN heads b ON a.s = b.s AND a.doc_id < b.doc_id),
    compared AS (
        SELECT u, v, a.n + b.n AS total, len(list_intersect(a.items, b.items)) AS shared
        FROM candidates JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v
        WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    ),
    found AS MATERIALIZED (SELECT u, v FROM compared WHERE 100 * shared >= 85 * (total - shared)),
    links AS MATERIALIZED (SELECT u, v FROM found UNION ALL SELECT v, u FROM found),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION
        SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other
    ),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN least USING (doc_id) LEFT JOIN sets s USING (doc_id)
"""

VECTORS = """
    WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    squared AS (
        SELECT vec_id, v, CASE WHEN len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_sum(list_transform(v, lambda x: x * x)) END AS square
        FROM vectors
    ),
    sound AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(square)) AS v FROM squared WHERE square > 0),
    links AS MATERIALIZED (
        SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) >= 0.95 END
    ),
    counted AS (SELECT u, count(*) AS n FROM links GROUP BY u),
    reach AS (
        SELECT vec_id, vec_id AS other FROM vectors
        UNION
        SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other
    ),
    least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM least LEFT JOIN counted ON u = vec_id
"""
