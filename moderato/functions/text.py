"""Text cleaning, tokenising, truncation and the sigmoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moderato.functions.lexicon import WORD_PATTERN

# Java regexes run with (?U) so that \s \d \b \w are Unicode-aware, the way
# Python's `re` treats str patterns.
# Fixed values (must equal the reference): URL and IPv4 shapes removed by cleaning.
URL_PATTERN = r"https?://\S+|www\.\S+"
IPV4_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
# Cleaning keeps only lowercase ASCII letters, whitespace and apostrophes.
KEEP_PATTERN = r"[^a-z\s']"
# Translation inputs are cut to this many code points.
TRANSLATION_MAX_CHARS = 400
# End of fixed values.


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def as_text(col: Column | str) -> Column:
    """NULL (non-string) text becomes the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def clean_text(col: Column | str) -> Column:
    """Normalise a comment: lower, drop URLs and IPv4-shaped numbers, keep
    only ``a-z``, whitespace and apostrophes, collapse whitespace, strip."""
    t = F.lower(as_text(col))
    t = F.translate(t, "\n\t", "  ")
    t = F.regexp_replace(t, _u(URL_PATTERN), " ")
    t = F.regexp_replace(t, _u(IPV4_PATTERN), " ")
    t = F.regexp_replace(t, _u(KEEP_PATTERN), " ")
    t = F.regexp_replace(t, _u(r"\s+"), " ")
    return F.trim(t)


def tokens(col: Column | str) -> Column:
    """All ``[a-z']+`` runs of the lowered text, in order (empty for NULL)."""
    return F.regexp_extract_all(F.lower(as_text(col)), F.lit(WORD_PATTERN), 0)


def strip(col: Column) -> Column:
    """Strip Unicode whitespace at both ends (Python ``str.strip``)."""
    return F.regexp_replace(col, _u(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"), "")


def is_scoreable(col: Column | str) -> Column:
    """A string that is non-empty after stripping whitespace."""
    return as_text(col).rlike(_u(r"[^\s\x1c-\x1f]"))


def truncate_for_translation(col: Column | str, max_chars: int = TRANSLATION_MAX_CHARS) -> Column:
    """First ``max_chars`` code points, newlines to spaces, stripped."""
    t = F.substring(as_text(col), 1, max_chars)
    return strip(F.translate(t, "\n", " "))


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
