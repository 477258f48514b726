"""Conversation repair: the cheapest edits that leave ``(system? (user assistant)+)?``, by branch and bound.

``audits`` reads each conversation in order and finds its edits, one letter each: K(eep), R(erole), D(elete),
I(nsert). The search is depth-first over an explicit stack. A node is (rows done, last role kept); a table
holds the best (cost, audit) that reached it, so a worse prefix ends there; a suffix lower bound per node (the
cheapest edits of the remaining rows if the conversation might end anywhere) ends prefixes that cannot beat the
incumbent. The search is over when the stack is empty, which proves the incumbent.

Spark brings the rows of a conversation together in order, sorted on disk where it must, and Python reads them
as a stream. A long conversation is searched in blocks of ``BLOCK`` rows: a block starts from the best (cost,
audit) of each last role and keeps the best of each, which is the dominance rule at the block's end, so results
are those of one search. What is held is a block, and the audits, which are part of the result.

``repaired_rows`` applies the audits to the rows.

Null ids form one conversation; null roles and texts are one space, so such a text is blank and such a role never
stays. Rows go by turn, nulls first, then by role and text; rows equal in all are interchangeable. A role other
than system, user and assistant, an empty one too, can only be changed or deleted. A role counts by its first
character. Texts are read whole, of any length. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import tidy, written

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
#: Rows of one search; longer conversations are searched block by block.
BLOCK = 64
#: The white space of all patterns here.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]"
ROWS = 5_000

# the last role kept: none yet, system, user, assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be inserted or given next.
NEXT = (USER, USER, ASSISTANT, USER)
LETTER = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
GIVEN = {USER: "user", ASSISTANT: "assistant"}
#: A conversation may end with nothing kept or after an assistant.
ENDS = {NONE: "end", ASSISTANT: "end"}
ANY = {state: state for state in range(4)}


def choices(row: tuple[str, int], state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of each edit of one row (role's first character, fault)."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    left = LEFT_TRUNCATED if fault == TRUNCATED else 0
    if initial == "s" and state == NONE:
        yield "K", left, SYSTEM
    if initial == LETTER[NEXT[state]]:
        yield "K", left, NEXT[state]
    else:
        yield "R", REROLE + left, NEXT[state]


def suffix_bounds(rows: list[tuple[str, int]]) -> list[list[int]]:
    """For each number of rows done and each state, no more than what the remaining rows cost."""
    bounds = [[0] * 4]
    for row in reversed(rows):
        after = bounds[-1]
        plain = [min(cost + after[then] for _, cost, then in choices(row, state)) for state in range(4)]
        one = [min(plain[s], INSERT + plain[NEXT[s]]) for s in range(4)]
        bounds.append([min(plain[s], INSERT + one[NEXT[s]]) for s in range(4)])
    return bounds[::-1]


def search(rows: list[tuple[str, int]], starts: dict[int, tuple[int, str]], goals: dict) -> dict:
    """The best (cost, audit) of each goal, from the best (cost, audit) of each starting state.

    ``goals`` names the goal that a state reaches once all rows are done.
    """
    bounds, best, incumbent = suffix_bounds(rows), {}, {}
    wanted = set(goals.values())
    stack = sorted(((cost, audit, 0, state) for state, (cost, audit) in starts.items()), reverse=True)
    while stack:
        cost, audit, done, state = stack.pop()
        known = best.get((done, state))
        if known is not None and known <= (cost, audit):
            continue
        least = cost + bounds[done][state]
        if len(incumbent) == len(wanted) and all(c < least or (c == least and a[: len(audit)] < audit) for c, a in incumbent.values()):
            continue
        best[done, state] = (cost, audit)
        nodes = [(cost + INSERT, audit + "I", done, NEXT[state])]
        if done < len(rows):
            nodes += [(cost + more, audit + letter, done + 1, then) for letter, more, then in choices(rows[done], state)]
        elif state in goals:
            goal = goals[state]
            incumbent[goal] = min(incumbent.get(goal, (cost, audit)), (cost, audit))
        # the most promising node is taken next
        nodes.sort(key=lambda n: (n[0] + bounds[n[2]][n[3]], n[1]), reverse=True)
        stack += nodes
    return incumbent


class Repair:
    """The search over a stream of rows, in blocks."""

    def __init__(self, block: int = BLOCK):
        self.block, self.rows, self.starts = block, [], {NONE: (0, "")}

    def add(self, row: tuple[str, int]) -> None:
        if len(self.rows) == self.block:
            self.starts = self._advance(ANY)
            self.rows = []
        self.rows.append(row)

    def _advance(self, goals: dict) -> dict:
        # an audit's beginning is replaced by one character in the same order; of two that begin alike, the longer keeps its end
        heads, short = [], {}
        for state, (cost, audit) in sorted(self.starts.items(), key=lambda x: x[1][1]):
            if not heads or not audit.startswith(heads[-1]):
                heads.append(audit)
            short[state] = (cost, chr(len(heads)) + audit[len(heads[-1]) :])
        found = search(self.rows, short, goals)
        return {goal: (cost, heads[ord(audit[0]) - 1] + audit[1:]) for goal, (cost, audit) in found.items()}

    def result(self) -> tuple[int, str]:
        return self._advance(ENDS)["end"]


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role, text)


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``ordered_rows``, together by conversation and in order, with each row's first fault (0: none)."""
    kept = F.rtrim("text", F.lit(SPACE))
    truncated = ~F.right(kept, F.lit(1)).isin(".", "!", "?")
    # the window sorts within the partitions of the conversations
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(kept == "", BLANK).when(F.col("seen"), DUPLICATE).when(truncated, TRUNCATED).otherwise(0)
    faulty = rows.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault.cast("int"))
    # of rows equal in all, the one that counts as first comes first
    return faulty.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "seen").drop("seen")


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AUDIT_KINDS = [pa.int64()] * 7 + [pa.string()]


def batches_of(rows: Iterator[tuple], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    schema, held = pa.schema(list(zip(names, kinds))), []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema=schema)


def streamed(batches, *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def audits(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation: ``AUDIT``. ``gaps`` are turn numbers missing between the first and the last."""
    rows = with_faults(ordered_rows(conversations)).select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")

    def audit(conv_id, own) -> tuple:
        faults, illegal, distinct, first, last, before, repair = [0] * 4, 0, 0, None, None, None, Repair(block)
        for _, turn, initial, fault in own:
            faults[fault] += 1
            illegal += before is not None and before + initial not in ("su", "ua", "au")
            distinct += turn is not None and turn != last
            first, last, before = turn if first is None else first, turn, initial
            repair.add((initial, fault))
        gaps = 0 if first is None else min(last - first + 1 - distinct, 2**63 - 1)
        return (conv_id, gaps, *faults[1:], illegal, *repair.result())

    def run(batches):
        stream = groupby(streamed(batches, "conv_id", "turn", "initial", "fault"), key=itemgetter(0))
        yield from batches_of((audit(*group) for group in stream), [c.split()[0] for c in AUDIT.split(", ")], AUDIT_KINDS)

    return rows.mapInArrow(tidy(run), AUDIT)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired_rows(conversations: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired conversations: ``REPAIRED``, numbered from 0; ``edit`` is K, R or I.

    Rows of one conversation are together and in order, and stay so for a ``mapInArrow`` that follows.
    """
    turn = F.col("turn").asc_nulls_first()
    lists = audited.select("conv_id", F.lit(0).alias("kind"), "audit")
    rows = ordered_rows(conversations).withColumn("kind", F.lit(1))
    both = rows.unionByName(lists, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", turn, "role", "text")

    def repaired(conv_id, own):
        audit, place, state = next(own)[-1], 0, NONE
        for edit in audit:
            _, role, text, _ = (None, None, "", None) if edit == "I" else next(own)
            if edit == "D":
                continue
            if edit == "K" and role.startswith("s"):
                state = SYSTEM
            else:
                state = NEXT[state]
                role = role if edit == "K" else GIVEN[state]
            yield conv_id, place, edit, role, text
            place += 1

    def run(batches):
        stream = groupby(streamed(batches, "conv_id", "role", "text", "audit"), key=itemgetter(0))
        rows = (row for group in stream for row in repaired(*group))
        yield from batches_of(rows, ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64()] + [pa.string()] * 3)

    return both.mapInArrow(tidy(run), REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation of ``repaired_rows`` as ``role:text`` lines; conversations without rows are absent."""

    def digest(own) -> str:
        done = hashlib.sha256()
        for k, (_, role, text) in enumerate(own):
            done.update(f"{chr(10) * (k > 0)}{role}:{text}".encode())
        return done.hexdigest()

    def run(batches):
        stream = groupby(streamed(batches, "conv_id", "role", "text"), key=itemgetter(0))
        yield from batches_of(((conv_id, digest(own)) for conv_id, own in stream), ["conv_id", "sha256"], [pa.int64(), pa.string()])

    return repaired.mapInArrow(run, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the query prescribes, by a checksum of conversation and turn modulo 20."""
    rows = ordered_rows(conversations)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, then audits of all conversations and the digest of each repaired one."""
    rows = damaged(conversations)
    audited = written(audits(rows), "audits")
    shas = digests(repaired_rows(rows, audited)).withColumnRenamed("conv_id", "repaired")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    own = audited.withColumnRenamed("conv_id", "own")
    counts = [c.split()[0] for c in AUDIT.split(", ")[1:-1]]
    joined = ids.join(own, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("repaired")), "left")
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
