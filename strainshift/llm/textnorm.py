"""Column expressions on text: ASCII lower case and words, as the contracts state them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words: every ASCII character that is no letter or digit.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text whose case is kept, and alternating words and gaps of it.
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PIECE = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def ascii_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; none for null or empty text."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1)
    return F.filter(parts, lambda w: w != "")
