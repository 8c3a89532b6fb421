"""Text expressions that agree with the full-text tokenizer."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The combining marks that the tokenizer drops, as they only change the letter before.
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _fold(letter: str) -> str:
    """What the tokenizer makes of a letter: a Latin letter with one mark loses it, other letters lose their case."""
    parts = unicodedata.normalize("NFD", letter)
    if len(parts) == 2 and parts[1] in MARKS and parts[0].casefold().isascii():
        return parts[0].casefold()
    lower = letter.casefold()
    lower = lower if len(lower) == 1 else letter.lower() if len(letter.lower()) == 1 else letter
    parts = unicodedata.normalize("NFD", lower)
    return parts[0] if len(parts) == 2 and parts[1] in MARKS and parts[0].isascii() else lower


#: Letters that lower-casing leaves other than the tokenizer does, and what it makes of them.
ACCENTS = "".join(c for c in map(chr, range(0x80, 0xD800)) if c.isalpha() and c.lower() == c and _fold(c) != c)
FOLDED = "".join(map(_fold, ACCENTS))
_FOLD = str.maketrans(ACCENTS, FOLDED, MARKS)
#: A token in a text as it stands, marks and all.
WORD = re.compile(rf"[^\W_](?:[^\W_]|[{MARKS}])*")


def folded(c: Column) -> Column:
    return F.translate(F.lower(c), ACCENTS + MARKS, FOLDED)


def fold(word: str) -> str:
    """folded() of a Python string."""
    return word.lower().translate(_FOLD)


def tokens(c: Column) -> Column:
    """Maximal runs of letters and digits, case-folded, without marks."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def inline(c: Column) -> Column:
    """Line breaks as spaces, trimmed; empty as null."""
    trimmed = F.regexp_replace(F.regexp_replace(c.cast("string"), r"[\r\n]+", " "), r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def query_terms(query: str) -> list[list[str]]:
    """The words of a search string, each as the tokens that must follow one another; words that repeat, repeat."""
    found = ([fold(t) for t in re.findall(r"[^\W_]+", word)] for word in re.findall(r"\w+", query))
    return [tokens for tokens in found if tokens]


def flat(value: object) -> list[str]:
    """All there is to read in a value, depth first: keys in order, each before its own value; nulls say nothing."""
    if value is None:
        return []
    if isinstance(value, dict):
        return [text for key in sorted(value) for text in (key, *flat(value[key]))]
    if isinstance(value, list):
        return [text for item in value for text in flat(item)]
    return [str(value)]
