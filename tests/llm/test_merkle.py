"""The manifest against plain hashing and against SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstrand.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_are_a_permutation_and_halves_are_contiguous(levels):
    places = [merkle.address(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(levels))) and places[0].tolist() == [0]
    if levels > 1:
        upper = levels // 2
        assert max(p.max() for p in places[:upper]) == merkle.nodes_in(upper) - 1
        roots = places[upper]
        assert np.diff(roots).tolist() == [merkle.nodes_in(levels - upper)] * (len(roots) - 1)


def test_a_block_holds_every_node():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(11)]
    nodes = merkle.build_block(leaves, 4)
    row = [x.hex() for x in leaves]
    for level in merkle.siblings(nodes, 4, 11):
        assert [before + row[i] + after for i, (before, after) in enumerate(level)] == ["".join(row[i - i % 3 : i - i % 3 + 3]) for i in range(len(row))]
        row = [sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)]
    assert nodes[:32].hex() == row[0] and len(row) == 1


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 3])) for i in range(0, len(found[-1]), 3)])
    return found


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain hashing."""
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    trees = {}
    for r in rows:
        now = r[1].replace("\n", "") if r[1] is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0 else r[1]
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, now), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s])]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, now, doc_id) in enumerate(sorted(trees[s])):
            proof, current = "", now
            for levels, at in ((built[s], i), (top, k)):
                for row in levels[:-1]:
                    run = at - at % 3
                    before, after = "".join(row[run:at]), "".join(row[at + 1 : run + 3])
                    proof, current, at = proof + before + after, sha(before + current + after), at // 3
            out.append((doc_id, own, built[s][-1][0], top[-1][0], sha(proof), current, current == top[-1][0]))
    return out


def odd_rows():
    rows = [(i, f"text {i}\nline" if i % 3 else f"plain {i}", "en", "hot", i) for i in range(700)]
    rows += [(None, "a\nb", None, None, None), (None, "a\nb", None, None, None), (5, None, "de", None, 0), (7, "", "", "", 0), (7, "", "", "", 0), (7, "\n\n", "", "", 0)]
    rows += [(1000 + i, "é\n陳" * 9, "x", f"s{i}", -i) for i in range(60)]
    return rows + [(2000, "long\n" * 400_000, "en", "big", 1), (-3, "neg\n", "en", "hot", 1)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("full", [3, merkle.LEVELS])
def test_odd_rows_in_few_and_many_tiers(spark, tmp_path, full):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("idx", F.lit(-1))
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    found = merkle.audited(docs, lambda text: F.when(tampered, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text), full=full)
    got = sorted(map(repr, map(tuple, found.withColumn("proof", F.sha2("proof", 256)).collect())))
    assert got == sorted(map(repr, brute(rows)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select doc_id, text, lang, source, n_chars from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, duck.execute(queries.ORACLE_SQL["op11_merkle"]).fetchall())) == got


def test_a_source_of_several_blocks_and_small_tables(spark):
    rows = [(i, f"t{i}\n", "en", "one", i) for i in range(5_000)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    change = lambda text: F.when(tampered, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    found = merkle.audited(spark.createDataFrame(rows, SCHEMA).repartition(7), change).withColumn("proof", F.sha2("proof", 256))
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows))
    lone = merkle.audited(spark.createDataFrame(rows[:1], SCHEMA)).first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof == "" and lone.verified
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).count() == 0
