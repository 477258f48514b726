"""Rule-based classifiers over mission types, call signs, diagnoses and free text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid import vocab


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True if the text holds one of the terms; null text gives null."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def term_match(text: Column, any_of: Sequence[str], none_of: Sequence[str] = ()) -> Column:
    """Case-insensitive substring rule; never null."""
    folded = F.lower(text)
    hit = contains_any(folded, [t.lower() for t in any_of])
    if none_of:
        hit = hit & ~contains_any(folded, [t.lower() for t in none_of])
    return F.coalesce(hit, F.lit(False))


def word_match(text: Column, word: str, no_words: Sequence[str] = (), no_parts: Sequence[str] = ()) -> Column:
    """Whole-word rule without regard to case, minus other whole words and substrings; never null."""
    hit = text.rlike(rf"(?iu)\b{word}\b")
    for other in no_words:
        hit = hit & ~text.rlike(rf"(?iu)\b{other}\b")
    for part in no_parts:
        hit = hit & ~F.lower(text).contains(part)
    return F.coalesce(hit, F.lit(False))


def covering_words(phrases: Sequence[str]) -> list[str]:
    """Few words such that every phrase holds at least one: each time the one in most phrases left, then the longest."""
    left, chosen = list(phrases), []
    while left:
        words = {w for p in left for w in p.split() or [p]}
        held = {w: sum(w in p for p in left) for w in words}
        chosen.append(max(words, key=lambda w: (held[w], len(w), w)))
        left = [p for p in left if chosen[-1] not in p]
    return chosen


def first_label(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule one of whose phrases occurs in the text, else null.

    A text without any of the words that cover all phrases is out after a search for these few.
    """
    label = F.lit(None).cast("string")
    for name, phrases in reversed(rules):
        label = F.when(contains_any(text, phrases), name).otherwise(label)
    phrases = [p for _, own in rules for p in own]
    words = covering_words(phrases)
    return F.when(contains_any(text, words), label) if 2 * len(words) <= len(phrases) else label


def first_category(text: Column, keywords: Sequence[tuple[str, str]]) -> Column:
    """Category of the first keyword found in the lower-cased text, else null."""
    folded = F.lower(text)
    return first_label(folded, [(category, [word.lower()]) for word, category in keywords])


def requirement_columns(
    text: Column,
    fields: Mapping[str, Sequence[tuple[str, Sequence[str]]]] = vocab.REQUIREMENT_RULES,
    mention: tuple[str, str] = vocab.MENTION_RULE,
) -> dict[str, Column]:
    """Label columns of the transport-requirement classifier; ``text`` is already lower case."""
    columns = {name: first_label(text, rules) for name, rules in fields.items()}
    flag, word = mention
    columns[flag] = F.coalesce(text.contains(word), F.lit(False))
    return columns


def basic_requirement_columns(text: Column) -> dict[str, Column]:
    """Case-sensitive three-field variant of the requirement classifier."""
    return {name: first_label(text, rules) for name, rules in vocab.BASIC_REQUIREMENT_RULES.items()}


def vehicle_type(call_sign: Column) -> Column:
    return (
        F.when(call_sign.isNull(), vocab.UNKNOWN)
        .when(call_sign.contains("-83-"), "RTW")
        .when(call_sign.contains("-85-1"), "S-KTW")
        .otherwise(call_sign)
    )


def mission_category(mission_type: Column) -> Column:
    folded = F.lower(mission_type)
    carried, not_carried, other = vocab.MISSION_CATEGORIES
    return (
        F.when(mission_type.isNull(), vocab.UNKNOWN)
        .when(folded.contains("s-ktw - transport"), carried)
        .when(contains_any(folded, ["s-ktw - kein transport", "kein-transport"]), not_carried)
        .otherwise(other)
    )


def without_transport(mission_type: Column) -> Column:
    """Mission types that name a missing transport or care."""
    return term_match(mission_type, ["kein", "ohne"])


def vehicle_class(mission_type: Column) -> Column:
    """Vehicle class a mission type names; ``other`` if none."""
    folded = F.lower(mission_type)
    hyphenated = folded.contains("s-ktw")
    return (
        F.when(folded.contains("nef"), "nef")
        .when(folded.contains("rtw") & ~hyphenated, "rtw")
        .when(hyphenated | folded.contains("sktw"), "s-ktw")
        .when(folded.contains("ktw"), "ktw")
        .otherwise("other")
    )


def mission_sort_key(mission_type: Column) -> Column:
    """Legend order: vehicle class, then with before without transport, then the name.

    Hyphenated S-KTW types are one block sorted by name only.
    """
    kind = vehicle_class(mission_type)
    rank = F.array_position(F.array(*[F.lit(c) for c in vocab.VEHICLE_CLASSES]), kind)
    one_block = (kind == "s-ktw") & F.lower(mission_type).contains("s-ktw")
    return F.struct(
        rank.cast("int").alias("class_rank"),
        (without_transport(mission_type) & ~F.coalesce(one_block, F.lit(False))).alias("late"),
        mission_type.alias("name"),
    )


def display_bucket(mission_type: Column) -> Column:
    """Vehicle class plus a mark for missions without transport, as the weekly chart groups them."""
    folded = F.lower(mission_type)
    missing = contains_any(folded, ["kein transport", "keine versorgung"])
    # Without transport the plain patient-transport term is looked for before the
    # emergency one, with transport after it.
    dark = F.coalesce(first_label(folded, vocab.NO_TRANSPORT_BUCKETS), F.lit("other"))
    light = F.coalesce(first_label(folded, vocab.TRANSPORT_BUCKETS), F.lit("other"))
    return (
        F.when(mission_type.isNull(), "other")
        .when(missing, F.concat(dark, F.lit(" (no transport)")))
        .otherwise(light)
    )


def alarm_status(status: Column) -> Column:
    """Where the vehicle stood when alarmed."""
    return (
        F.when(status == vocab.STATUS_ON_RADIO, "on_radio")
        .when(status == vocab.STATUS_AT_STATION, "at_station")
        .otherwise("other")
    )
