"""Text normalisation, tokens and number extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Without (?U) this is the 32 ASCII punctuation characters; curly quotes and the like stay.
ASCII_PUNCTUATION_RUN = r"\p{Punct}+"
# (?U) gives the Unicode classes; the separators x1c to x1f are not in Java's \s.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NUMBER = r"(?U)(-?\d+\.?\d*)"


def strip(c: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def normalize_text(c: Column) -> Column:
    """Lower case, without ASCII punctuation, white-space runs as one space, stripped."""
    bare = F.regexp_replace(F.lower(c), ASCII_PUNCTUATION_RUN, "")
    return F.trim(F.regexp_replace(bare, WHITESPACE_RUN, " "))


def last_number(c: Column) -> Column:
    """The last number in the text, as text, commas removed; NULL when there is none."""
    found = F.regexp_extract_all(F.replace(c, F.lit(","), F.lit("")), F.lit(NUMBER), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def tokens(c: Column) -> Column:
    """White-space tokens; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WHITESPACE_RUN), "")


def spaced(words: Column) -> Column:
    """A text of tokens, the counterpart of ``tokens``."""
    return F.array_join(words, " ")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def hard_truncate(c: Column, limit: Column | int) -> Column:
    """Keep the first ``limit`` tokens; a text within the limit is returned unchanged."""
    limit = F.lit(limit)
    words = tokens(c)
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, F.lit(1), limit), " ")).otherwise(c)


def first_words(limit: int) -> Callable[[str], str]:
    """Shortens one text to its first white-space words; shorter ones are left as they are."""

    def shorten(text: str) -> str:
        words = text.split()
        return text if len(words) <= limit else " ".join(words[:limit])

    return shorten


def final_answer(c: Column) -> Column:
    """The stripped text after the last ``####``; the whole text when there is no mark."""
    return strip(F.element_at(F.split(c, "####"), -1))


def flatten_context(titles: Column, sentences: Column) -> Column:
    """One ``title: sentences`` paragraph per pair, each followed by a blank line.

    Pairs stop at the shorter array.
    """
    n = F.least(F.size(titles), F.size(sentences))
    paragraphs = F.zip_with(
        F.slice(titles, F.lit(1), n),
        F.slice(sentences, F.lit(1), n),
        lambda title, lines: F.concat(title, F.lit(": "), F.array_join(lines, " "), F.lit("\n\n")),
    )
    return F.array_join(paragraphs, "")


def first_or_empty(items: Column) -> Column:
    """The first array element, or empty text for an empty or NULL array."""
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))
