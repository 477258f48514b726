"""Free-text helpers: choice of the text field, previews, prompts, answer parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid import vocab
from pulsegrid.functions.clean import strip


def pick_text(preferred: Sequence[Column], fallback: Sequence[Column] = ()) -> Column:
    """First preferred field that is not blank, else the first such fallback field; trimmed. All blank: null."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in (*preferred, *fallback)])


def preview(text: Column, size: int = 100) -> Column:
    """Beginning of a text for display, beside the text itself."""
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def text_key(text: Column) -> Column:
    """Key of a whole text, so that long texts are compared and shuffled as 64 characters."""
    return F.sha2(text, 256)


def prompt(text: Column, template: str = vocab.PROMPT) -> Column:
    head, tail = template.split("{text}")
    return F.concat(F.lit(head), text, F.lit(tail))


def _unfenced(lines: Column) -> Column:
    """Lines of the first fenced block: skip opening fence lines, stop at the next one."""
    fences = F.transform(lines, lambda line: F.startswith(strip(line), F.lit("```")))
    start = F.array_position(fences, F.lit(False)).cast("int")
    size = F.size(lines)
    rest = F.slice(fences, F.greatest(start, F.lit(1)), size)
    close = F.array_position(rest, F.lit(True)).cast("int")
    length = F.when(close == 0, size).otherwise(close - 1)
    return F.when(start == 0, F.slice(lines, 1, 0)).otherwise(
        F.slice(lines, F.greatest(start, F.lit(1)), length)
    )


def answer_pairs(answer: Column) -> Column:
    """``KEY: value`` lines of an answer as an array of (key, value), keys in upper case."""
    whole = strip(answer)
    lines = F.split(whole, "\n", -1)
    lines = F.when(F.startswith(whole, F.lit("```")), _unfenced(lines)).otherwise(lines)
    return F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            F.upper(strip(F.substring_index(line, ":", 1))).alias("key"),
            strip(F.substr(line, F.instr(line, F.lit(":")) + 1)).alias("value"),
        ),
    )


def _cleaned(value: Column) -> Column:
    """Enclosing brackets off; list items and bold markers count as empty."""
    bracketed = F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]")) & (F.char_length(value) > 1)
    inner = F.substring(value, F.lit(2), F.char_length(value) - 2)
    bare = strip(F.when(bracketed, inner).otherwise(value))
    return F.when(F.startswith(bare, F.lit("- ")) | F.startswith(bare, F.lit("**")), "").otherwise(bare)


def answer_columns(keys: Column, values: Column, fields: Mapping[str, str] = vocab.ANSWER_FIELDS) -> dict[str, Column]:
    """One text column per field from the keys and values of ``answer_pairs``, last line first.

    The last line of a key wins; a missing key is empty text.
    """
    def last_of(key: str) -> Column:
        return F.get(values, F.array_position(keys, key).cast("int") - 1)

    return {name: F.coalesce(_cleaned(last_of(key)), F.lit("")) for key, name in fields.items()}
