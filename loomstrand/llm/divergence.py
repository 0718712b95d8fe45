"""Divergence of sources within a language, by a K-squared quadtree over counts of terms.

Terms are runs of letters A-Z and of characters beyond ASCII, with only A-Z lower-cased. A language keeps the terms that stand
in at least `LEAST` of its documents: V of them. A group (language, source) that holds N kept terms in all gives a term of
count c the weight p = 1 + floor(10^9 (c + 2) / (N + 2 V)); two weights diverge by floor((p - q)^2 / (p + q)). All of it is integer
arithmetic: the quotient is taken in three steps of three digits each, exact up to 9 * 10^15 terms a group.

Counts come pre-added from each task (no text is shuffled), and one shuffle by (language, term) gives every term its column of
counts. Columns of a language are dealt into strips by a hash; a task walks the quadtrees of a strip's groups together, prices
what is empty on both sides at once (a pair's number of empty columns times one price) and gives every pair of groups its share of
the sum. A strip holds about `CELLS` cells at most, whatever the number of groups; the pairs of groups are the result asked for.

Null text, language and source count as empty texts. Repeated rows count as often as they come. A group without a kept
term is still compared, and a language without one has divergences of 0. A language of one source has no pairs. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstrand.llm.common import materialise, slices
from loomstrand.llm.quadtree import build, pair_sums

LEAST, SCALE, TOP = 10, 1_000_000_000, 10
#: Pre-added counts that a task holds, bytes of text that it cuts into words at once, cells of a strip, and the most columns of one.
HELD, PIECE, CELLS, WIDEST = 150_000, 1 << 20, 1 << 20, 8_192
#: Sides of the trees: 2^7 for few groups, 2^10 at most; more groups are walked in pairs of blocks.
SHALLOW, DEEP = 7, 10

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about a megabyte of it."""
    raw = text.encode().translate(_LETTERS)
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[begin:end].split()
        begin = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of every group, a row of no term for every group that occurs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in held.items():
                n = len(terms)
                columns = [pa.array([lang] * n), pa.array([source] * n), pa.array(list(terms), pa.binary()).cast(pa.string()), pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in slices(batches, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                group = held.setdefault((lang, source), {b"": [0, 0]})
                size -= len(group)
                own: Counter[bytes] = Counter()
                for part in words(text):
                    own.update(part)
                for term, n in own.items():
                    if (found := group.get(term)) is None:
                        group[term] = [n, 1]
                    else:
                        found[0] += n
                        found[1] += 1
                size += len(group)
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return filled.mapInArrow(counted, "lang string, source string, term string, n long, docs long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def weight(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total), by three digits at a time so that it stays within long integers."""
    quotient, rest = _div(count, total), count % total
    for _ in range(3):
        quotient, rest = quotient * 1000 + _div(rest * 1000, total), (rest * 1000) % total
    return quotient + 1


def _weights(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The same over arrays."""
    quotient, rest = np.divmod(counts, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + more
    return quotient + 1


def _apart(p, q):
    return (p - q) * (p - q) // (p + q)


def term_columns(docs: DataFrame) -> DataFrame:
    """(lang, term, cells array<struct<source, n>>) of the kept terms, and of an empty term with all groups of each language."""
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    columns = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("docs").alias("docs"))
    return columns.where((F.col("docs") >= LEAST) | (F.col("term") == "")).drop("docs")


def group_totals(columns: DataFrame) -> DataFrame:
    """(lang, source, place, total, lang_total, kept, strips): what weights need of each group, its number in its language, and the
    strips that the language's columns are dealt into."""
    cells = columns.select("lang", "term", F.explode("cells").alias("c"))
    totals = cells.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    kept = columns.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"))
    language = Window.partitionBy("lang")
    rows = totals.join(kept, "lang").withColumns({"place": F.row_number().over(language.orderBy("source")) - 1, "lang_n": F.sum("n").over(language), "groups": F.count("*").over(language)})
    width = F.greatest(F.lit(1 << SHALLOW), F.least(F.lit(WIDEST), _div(F.lit(CELLS), F.col("groups"))))
    both = 2 * F.col("kept")
    return rows.select("lang", "source", "place", (F.col("n") + both).alias("total"), (F.col("lang_n") + both).alias("lang_total"), "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / width)).cast("long").alias("strips"))


def strip_sums(columns: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, source, other, value): what one strip adds to the divergence of every two groups of its language, source before other.

    `columns`: (sources, counts) lists of each term; `groups`: (lang, source, place, total).
    """
    groups = groups.sort_by("place")
    sources, totals = groups.column("source").combine_chunks(), groups.column("total").to_numpy()
    n, width = len(totals), columns.num_rows
    value = np.zeros((n, n), np.int64)
    if width:
        lists, counts = columns.column("sources").combine_chunks(), columns.column("counts").combine_chunks()
        rows = lists.flatten().to_pandas().map({s: i for i, s in enumerate(sources.to_pylist())}).to_numpy(np.int64)
        places = np.repeat(np.arange(width), np.diff(lists.offsets.to_numpy()))
        cells = counts.flatten().to_numpy()
        depth = min(DEEP, max(SHALLOW, (n - 1).bit_length()))
        side = 1 << depth
        for tile in range(0, width, side):
            inside = (places >= tile) & (places < tile + side)
            blank = max(0, tile + side - width)
            trees = []
            for block in range(0, n, side):
                own = inside & (rows >= block) & (rows < block + side)
                trees.append((block, min(side, n - block), build(rows[own] - block, places[own] - tile, cells[own], depth)))
            for x, (at, height, tree) in enumerate(trees):
                for to, across, other in trees[x:]:
                    a, b = totals[at : at + height], totals[to : to + across]
                    price = lambda i, j, c, d, a=a, b=b: _apart(_weights(c + 2, a[i]), _weights(d + 2, b[j]))
                    sums, zeros = pair_sums(tree, other, depth, (height, across), at == to, price)
                    twos = np.full(1, 2)
                    nothing = _apart(_weights(twos, a)[:, None], _weights(twos, b)[None, :])
                    value[at : at + height, to : to + across] += sums[:height, :across] + (zeros[:height, :across] - blank) * nothing
    i, j = np.triu_indices(n, 1)
    lang = pa.array([groups.column("lang")[0].as_py()] * len(i), pa.string())
    return pa.table({"lang": lang, "source": sources.take(pa.array(i)), "other": sources.take(pa.array(j)), "value": value[i, j]})


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of a group's language and their divergence over all
    kept terms; part `term` the `TOP` terms that most set a group, by more weight, apart from its language."""
    columns = materialise(term_columns(docs))
    totals = materialise(group_totals(columns))
    languages = totals.select("lang", "strips").distinct()
    dealt = columns.where("term <> ''").join(languages, "lang")
    parted = dealt.select(F.col("lang").alias("of"), F.pmod(F.xxhash64("term"), "strips").alias("at"), F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
    wanted = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)).alias("strip"), "source", "place", "total")
    shares = parted.groupBy("of", "at").cogroup(wanted.groupBy("lang", "strip")).applyInArrow(strip_sums, "lang string, source string, other string, value long")
    sums = shares.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = sums.select("lang", turned.alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")

    cells = columns.where("term <> ''").select("lang", "term", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("all"), F.explode("cells").alias("c"))
    cells = cells.select("lang", "term", "all", "c.source", "c.n").join(totals, ["lang", "source"])
    weighed = cells.withColumns({"p": weight(F.col("n") + 2, F.col("total")), "q": weight(F.col("all") + 2, F.col("lang_total"))}).where("p > q")
    apart = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    terms = weighed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart.alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= TOP))
