"""Text functions. White space and letters are named as Unicode classes, so that Java and other engines agree on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D\x1C-\x1F\x20\x{85}\p{Z}]"
LETTERS = r"[\p{L}\p{M}\p{N}_]"
#: Fixed value: thanks and goodbyes at the end of a Vietnamese utterance.
CLOSING_CUE = r"cảm ơn|cám ơn|tạm biệt|chào (anh|chị|em|cô|chú|bác|cháu|con)[^\p{L}\p{M}\p{N}_]*\z"
#: Fixed value: marks of formatted text in a reply.
MARKDOWN = r"(?m)(\*\*|^#+\s|^\s*[-*•]\s|^\s*\d+[.)]\s)"


def respace_punctuation(text: Column) -> Column:
    """Takes out the space before a lone mark of , ? . ! and the straight quote."""
    return F.regexp_replace(text, rf'{SPACE}([,?.!"](?:{SPACE}|\z))', "$1")


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " ")))


def opener_word(text: Column) -> Column:
    """The first word in lower case; empty if there is none."""
    return F.regexp_extract(F.lower(text), f"{LETTERS}+", 0)


def has_closing_cue(text: Column, pattern: str = CLOSING_CUE) -> Column:
    return F.lower(text).rlike(pattern)


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def unfenced(reply: Column) -> Column:
    """The inside of the first fenced block, or all of it; then from the first { to the last }. Null without both."""
    plain = F.trim(reply)
    inside = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(plain.rlike(r"(?s)```(?:json)?\s*(.*?)```"), F.trim(inside)).otherwise(plain)
    first, last = F.locate("{", body), F.length(body) - F.locate("}", F.reverse(body)) + 1
    none = (first == 0) | (F.locate("}", body) == 0)
    return F.when(~none, body.substr(first, F.greatest(last - first + 1, F.lit(0))))
