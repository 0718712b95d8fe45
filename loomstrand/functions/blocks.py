"""Contents of messages as lists of blocks: measures, clipping under one budget, and replacement texts.

A content is an array of `BLOCK` in surface order: a block, then the blocks inside it. `path` numbers a block among its
siblings behind its parent's path ("1.0" is the first block inside the second), so blocks nest as deep as they like. Text
blocks have `text`; rich blocks have their JSON in `rich` (keys sorted), and tool results their call and whether it failed. Nothing here reads it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstrand.functions.text import PRUNE_HEAD, PRUNE_MARKER, PRUNE_TAIL, PRUNE_THRESHOLD, utf16_length

BLOCK = "struct<path: string, kind: string, text: string, rich: string>"
#: Tokens for a message's role, and for each of its blocks.
ROLE_TOKENS, BLOCK_TOKENS = 4, 4


def blocks_of(content: Column, depth: int = 3) -> Column:
    """A JSON array of blocks as an array of BLOCK, down to `depth` levels; elements that are no objects are left out."""

    def level(items: Column, prefix: Column, left: int) -> Column:
        def one(item: Column, i: Column) -> Column:
            at = F.concat(prefix, i.cast("string"))
            at_path = lambda name, kind: F.try_variant_get(item, f"$.{name}", kind)
            kind = at_path("type", "string")
            result = F.to_json(F.struct(at_path("toolCallId", "string").alias("toolCallId"), at_path("isError", "boolean").alias("isError")))
            rich = F.when(kind == "tool-result", result).when(~kind.eqNullSafe("text"), F.to_json(item))
            text = F.when(kind == "text", F.coalesce(at_path("text", "string"), F.lit("")))
            own = F.array(F.struct(at.alias("path"), kind.alias("kind"), text.alias("text"), rich.alias("rich")))
            if left == 1:
                return own
            below = F.when(kind == "tool-result", level(at_path("content", "array<variant>"), F.concat(at, F.lit(".")), left - 1))
            return F.concat(own, F.coalesce(below, F.array().cast(f"array<{BLOCK}>")))

        good = F.filter(F.transform(items, lambda item, i: F.struct(item.alias("item"), i.alias("i"))), lambda x: F.try_variant_get(x["item"], "$", "map<string, variant>").isNotNull())
        return F.flatten(F.transform(good, lambda x: one(x["item"], x["i"])))

    return level(F.try_variant_get(F.try_parse_json(content), "$", "array<variant>"), F.lit(""), depth)


def _depth(block: Column) -> Column:
    return F.size(F.split(block["path"], r"\."))


def _counts(nested: bool):
    """Whether a block's text is measured: all text blocks, or those of the message itself."""
    return lambda b: (b["kind"] == "text") if nested else (b["kind"] == "text") & ~F.contains(b["path"], F.lit("."))


def measured(blocks: Column, nested: bool = True) -> Column:
    """Code points of the text blocks, of those inside others too (`nested`) or not; null and empty contents measure zero."""
    return F.coalesce(F.aggregate(F.filter(blocks, _counts(nested)), F.lit(0).cast("long"), lambda s, b: s + F.length(b["text"])), F.lit(0).cast("long"))


def token_sum(blocks: Column) -> Column:
    """Estimated tokens of a message: its role, its blocks, and a quarter of the UTF-16 units of each text."""
    return (ROLE_TOKENS + F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + BLOCK_TOKENS + F.coalesce(F.ceil(utf16_length(b["text"]) / 4), F.lit(0)))).cast("long")


def clipped(blocks: Column, limit: int = PRUNE_THRESHOLD, threshold: int = PRUNE_THRESHOLD, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL, nested: bool = True) -> Column:
    """The blocks with the middle of their text taken out, or null where the text has no more than `limit` code points.

    Head and tail are one budget over all texts in order: the removed interval is cut out of each text where they overlap, and
    the first that it touches gets the marker. Texts that end up empty go; all other blocks stay where they are.
    """
    if head + len(PRUNE_MARKER) + tail > threshold or limit < threshold:
        raise ValueError("head, marker and tail must fit into the threshold, and it into the limit")
    counts = _counts(nested)
    size = lambda b: F.when(counts(b), F.length(b["text"])).otherwise(0)
    ends = F.aggregate(blocks, F.array().cast("array<int>"), lambda ends, b: F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + size(b)))
    total = measured(blocks, nested)
    begin, end = F.lit(head), total.cast("int") - tail
    zipped = F.zip_with(blocks, ends, lambda b, e: F.struct(b.alias("b"), (e - size(b)).alias("at"), e.alias("end")))
    touched = lambda x: counts(x["b"]) & (x["at"] < end) & (x["end"] > begin)
    first = F.array_position(F.transform(zipped, touched), True)

    def cut(x: Column, i: Column) -> Column:
        b, n = x["b"], size(x["b"])
        kept = F.least(n, F.greatest(F.lit(0), begin - x["at"]))
        rest = F.least(n, F.greatest(F.lit(0), end - x["at"]))
        text = F.concat(F.substring(b["text"], F.lit(1), kept), F.when(first == i + 1, F.lit(PRUNE_MARKER)).otherwise(""), F.substring(b["text"], rest + 1, n))
        return F.struct(b["path"].alias("path"), b["kind"].alias("kind"), F.when(counts(b), text).otherwise(b["text"]).alias("text"), b["rich"].alias("rich"))

    made = F.filter(F.transform(zipped, cut), lambda b: ~F.coalesce(counts(b) & (b["text"] == ""), F.lit(False)))
    return F.when(total > limit, made)


def replaced(blocks: Column, text: Column) -> Column:
    """The blocks with `text` in place of what tool results say; null if there is no tool result, or no text at all.

    The text goes first into the first tool result of the message. Texts directly inside tool results go, all else stays in order.
    """
    results = F.filter(blocks, lambda b: (b["kind"] == "tool-result") & ~F.contains(b["path"], F.lit(".")))
    parents = F.transform(results, lambda b: b["path"])
    first = F.get(parents, F.lit(0))
    inner = lambda b: (_depth(b) == 2) & F.array_contains(parents, F.substring_index(b["path"], ".", 1))
    stays = F.filter(blocks, lambda b: ~((b["kind"] == "text") & inner(b)))
    new = F.struct(F.concat(first, F.lit(".summary")).alias("path"), F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("rich"))
    made = F.flatten(F.transform(stays, lambda b: F.when(b["path"] == first, F.array(b.cast(BLOCK), new.cast(BLOCK))).otherwise(F.array(b.cast(BLOCK)))))
    return F.when((F.size(results) > 0) & (measured(blocks) > 0), made)


def written(blocks: Column) -> Column:
    """The blocks as one text, for digests: path, kind and text or rich part of each."""
    return F.array_join(F.transform(blocks, lambda b: F.concat_ws(":", b["path"], b["kind"], F.coalesce(b["text"], b["rich"]))), "\n")


def sole_text(blocks: Column) -> Column:
    """The text of a content that is one text block and nothing else; null for any other, which no slot has."""
    first = F.get(blocks, F.lit(0))
    return F.when((F.size(blocks) == 1) & (first["kind"] == "text"), first["text"])
