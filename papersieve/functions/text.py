"""Text expressions: trimming, coercion, academic cleaning, tokens, n-grams.

Everything is a native Spark expression. ``(?U)`` makes Java's classes Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words removed from academic text after punctuation is blanked.
DOMAIN_WORDS = (
    "edu", "cn", "com", "org", "stanford", "harvard", "mit", "turing",
    "microsoft", "google", "deepmind", "ibm",
)
# Layout words removed before punctuation is blanked.
LAYOUT_WORDS = ("fig", "table", "eq", "section")

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf(inity)?))$"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes only the space)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def to_number(c: Column) -> Column:
    """Number by coercion; whatever is not a number becomes NULL."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def build_text(title: Column, abstract: Column, sep: str = "[SEP]") -> Column:
    """Title, separator, abstract; a missing part counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(abstract, F.lit("")))


def is_blank(*parts: Column) -> Column:
    """True when every part is missing or white space only."""
    blank = F.lit(True)
    for part in parts:
        blank = blank & (strip(F.coalesce(part, F.lit(""))) == "")
    return blank


def clean_academic_text(
    c: Column,
    domain_words: Sequence[str] = DOMAIN_WORDS,
    layout_words: Sequence[str] = LAYOUT_WORDS,
) -> Column:
    """Lower-case text without e-mails, links, citation marks, layout words, punctuation, domain words.

    Layout words go while letters outside a-z still count as letters; domain words go afterwards.
    Runs of a-z, digits and underscores are taken out and joined by one blank, which is several times
    faster than replacing all between them.
    """
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, r"(?U)(?<!\S)\S+@\S+", " ")
    c = F.regexp_replace(c, r"(?U)http\S+|doi:\S+", " ")
    c = F.regexp_replace(c, r"(?U)\[\d+\]", " ")
    c = F.regexp_replace(c, r"(?U)\b(?:" + "|".join(layout_words) + r")\b", " ")
    c = F.array_join(F.regexp_extract_all(c, F.lit(r"[a-z0-9_]+"), F.lit(0)), " ")
    c = F.regexp_replace(c, r"\b(?:" + "|".join(domain_words) + r")\b", " ")
    return F.trim(F.regexp_replace(c, r" {2,}", " "))


def long_enough(c: Column, min_chars: int = 50, inclusive: bool = True) -> Column:
    """Length bound; the whole-corpus flow includes the bound, the per-discipline flow does not."""
    return F.length(c) >= min_chars if inclusive else F.length(c) > min_chars


def tokenize_alpha(c: Column) -> Column:
    """Lower-case runs of a-z; an empty array when there are none."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def tokenize_space(c: Column) -> Column:
    """Tokens between white space; an empty array when there are none."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\S+)"), F.lit(1))


def tokenize_words(c: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores, as count vectorisers read text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def remove_words(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens not in the list (stop words, ``sep``, ...)."""
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*words))


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 1) -> Column:
    """All n-grams of n_min..n_max tokens, space-joined, within one document.

    Longer n-grams extend shorter ones by zipping with the shifted tokens. ``tokens`` is costly to make and
    used several times, so it goes in as the one element of an array, which Spark evaluates once.
    """
    if n_max == 1:
        return tokens

    def joined(own: Column) -> Column:
        grams, parts = own, []
        for n in range(1, n_max + 1):
            if n > 1:
                shifted = F.slice(own, n, F.size(own))
                grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
            if n >= n_min:
                parts.append(grams if n == 1 else F.filter(grams, lambda g: g.isNotNull()))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return F.get(F.transform(F.array(tokens), joined), F.lit(0))


def parse_list_column(c: Column) -> Column:
    """List literal (single or double quotes) to lower-case trimmed items; NULL to an empty array."""
    items = F.from_json(c, "array<string>")
    return F.coalesce(
        F.transform(items, lambda x: F.lower(strip(x))), F.array().cast("array<string>")
    )
