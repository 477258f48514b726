import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from benchset.check import compare, connect
from pulsegrid.llm import conversations as c
from pulsegrid.llm.queries import QUERIES, SQL

LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit) over all sequences of edits, for rows of (role, fault)."""
    sys.setrecursionlimit(10_000)

    @lru_cache(None)
    def go(at, last, inserted):
        found = [(0, "")] if at == len(rows) and last in ("", "a") else []
        options = [(5, "I", at, r, inserted + 1) for r in LEGAL[last] if r != "s"] if inserted < 4 else []
        if at < len(rows):
            role, fault = rows[at]
            options.append((2, "D", at + 1, last, 0))
            left = 5 * (fault == c.TRUNCATED)
            for r in LEGAL[last] if fault not in (c.BLANK, c.DUPLICATE) else "":
                if role[:1] == r:
                    options.append((left, "K", at + 1, r, 0))
                elif r != "s":
                    options.append((left + 1, "R", at + 1, r, 0))
        for cost, edit, *then in options:
            rest = go(*then)
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return go(0, "", 0)


def expected(rows):
    """The result for one conversation's rows of (turn, role, text), None in place of nulls."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, faults = set(), []
    for _, role, text in rows:
        kept = text.rstrip(c.SPACE)
        faults.append(c.BLANK if not kept else c.DUPLICATE if (role, text) in seen else c.TRUNCATED if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest(tuple((r, f) for (_, r, _), f in zip(rows, faults)))
    lines, left, last = [], iter(rows), ""
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(left)
        if edit != "D":
            role = role if edit == "K" else {"u": "user", "a": "assistant"}["a" if last == "u" else "u"]
            last = role[0]
            lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def harm(rows):
    """The prescribed damage over (conv_id, turn, role, text)."""
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def by_id(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def whole(rows, damage=True):
    found = {r[0]: [] for r in rows}
    for conv, *row in harm(rows) if damage else rows:
        found[conv].append(tuple(row))
    return {conv: expected(own) for conv, own in found.items()}


def test_search_finds_the_least_cost_and_audit():
    draw = random.Random(5)
    for _ in range(400):
        rows = tuple((draw.choice("suuaaax"), draw.choice([0, 0, 0, 1, 2, 3])) for _ in range(draw.randint(0, 12)))
        for block in (1, 2, 5, 64):
            repair = c.Repair(block)
            for row in rows:
                repair.add(row)
            assert repair.result() == cheapest(rows)


def test_bounds_never_exceed_the_rest():
    rows = [("u", 0), ("u", 3), ("a", 0), ("x", 2), ("s", 0), ("a", 1)]
    bounds = c.suffix_bounds(rows)
    for k in range(len(rows)):
        assert bounds[k][c.NONE] <= cheapest(tuple(rows[k:]))[0]


@pytest.mark.parametrize("block", [3, c.BLOCK])
def test_long_conversation_in_blocks(frame, block):
    draw = random.Random(8)
    rows = [(1, k, draw.choice(["user", "assistant", "assistant", "system"]), draw.choice(["a.", "b", "c!", "", f"{k}?"])) for k in range(300) if k % 17]
    own = by_id(c.audits(frame(rows, "conv_id long, turn long, role string, text string").repartition(4), block))
    assert own == {1: expected([r[1:] for r in rows])[:-1]}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(QUERIES["op13_conversations"](spark, sf)) == whole(rows)
    assert compare(spark, connect(sf), sf, "op13", QUERIES["op13_conversations"], SQL["op13_conversations"]) is None


def test_odd_rows_and_clashing_columns(frame):
    rows = [
        (None, 0, "user", "null id."), (None, 1, "assistant", "yes."), (1, None, "user", "no turn."), (1, None, None, "no role."), (1, 3, "assistant", None),
        (2, 0, "", "no name."), (2, 0, "tool", "Odd role."), (3, 0, "user", "x " * 50_000 + "."), (3, 0, "user", "x " * 50_000 + "."), (3, 0, "assistant", "é!"),
        (4, 5, None, None), (5, 1, "user", "\0 \t\r\n"), (5, 1, "user", "\0 \t\r\n"), (6, -(2**62), "user", "a."), (6, 2**62, "assistant", "b."), (7, 7, "system", "alone."),
    ]
    wide = frame([(*r, "x", k, k, "y") for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, audit string, fault int, kind int, seen string")
    assert by_id(c.repair_damaged(wide)) == whole(rows)
    assert {k: (*v, None) for k, v in by_id(c.audits(wide)).items()} == {k: (*v[:-1], None) for k, v in whole(rows, damage=False).items()}


def test_repaired_rows_keep_order_and_edits(frame):
    rows = frame([(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "user", "cut"), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    repaired = c.repaired_rows(rows, c.audits(rows)).collect()
    assert [tuple(r) for r in repaired] == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Well.")]


def test_empty_table(frame):
    assert c.repair_damaged(frame([], "conv_id long, turn long, role string, text string")).collect() == []
