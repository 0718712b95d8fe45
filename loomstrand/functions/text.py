"""Text measures and bounded texts, as column expressions.

Three lengths live side by side: code points (pruning), UTF-16 units (token estimates) and UTF-8 bytes (budgets).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for cut text, and its UTF-8 length.
ELLIPSIS, ELLIPSIS_BYTES = "…", 3
#: Tokens for the role and for the block around a text.
OVERHEAD_TOKENS = 8
# The ranges of ideographs that cost a token each.
IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]"

# What stands for a pruned middle, and the default budget.
PRUNE_MARKER = "\n\n[... tool result middle pruned ...]\n\n"
PRUNE_THRESHOLD, PRUNE_HEAD, PRUNE_TAIL = 8192, 4096, 1024


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units, of which each code point has one or two."""
    return (F.octet_length(F.encode(_column(text), "UTF-16BE")) / 2).cast("int")


def token_estimate(text: Column | str) -> Column:
    """Tokens of a message with this text: a quarter of its units, or one for each ideograph and a quarter of the rest."""
    text = _column(text)
    ideographs = F.regexp_count(text, F.lit(IDEOGRAPHS))
    rest = F.ceil((F.length(text) - ideographs) / 4)
    return (OVERHEAD_TOKENS + F.greatest(F.ceil(utf16_length(text) / 4), ideographs + rest)).cast("long")


def trimmed(text: Column | str) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_column(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    """Whether nothing but white space is there; null counts as blank."""
    return F.coalesce(trimmed(text), F.lit("")) == ""


def bounded(text: Column | str, limit: int | Column) -> Column:
    """The text if its UTF-8 form has `limit` bytes at most, else its longest prefix that leaves room for an ellipsis.

    The bytes are cut first; a code point that the cut broke is then taken off the end.
    """
    if isinstance(limit, int):
        if limit < ELLIPSIS_BYTES:
            raise ValueError(f"a limit of {limit} bytes has no room for the marker")
        limit = F.lit(limit)
    text = _column(text)
    cut = F.hex(F.substring(text.cast("binary"), F.lit(1), limit - ELLIPSIS_BYTES))
    whole = F.regexp_replace(cut, "(?:F[0-7](?:[89AB].){0,2}|E.(?:[89AB].)?|[CD].)$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(F.unhex(whole), "UTF-8"), F.lit(ELLIPSIS)))


def pruned(text: Column | str, threshold: int = PRUNE_THRESHOLD, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL) -> Column:
    """Head, marker and tail of a text of more than `threshold` code points; other texts as they are."""
    if head + len(PRUNE_MARKER) + tail > threshold:
        raise ValueError("head, marker and tail must fit into the threshold")
    text = _column(text)
    cut = F.concat(F.substring(text, F.lit(1), F.lit(head)), F.lit(PRUNE_MARKER), F.substring(text, F.length(text) - tail + 1, F.lit(tail)))
    return F.when(F.length(text) > threshold, cut).otherwise(text)


def without_fence(text: Column | str) -> Column:
    """A text without the code fence around it."""
    return F.regexp_replace(_column(text), r"(?s)\A\s*```[a-zA-Z]*\s*\n?(.*?)\n?\s*```\s*\z", "$1")
