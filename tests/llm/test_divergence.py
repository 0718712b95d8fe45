"""Divergence of sources against plain arithmetic and against SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomstrand.llm import divergence, quadtree, queries


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("filled", [0, 1, 9, 60])
def test_pair_sums_against_dense_matrices(same, filled):
    rng = np.random.default_rng(filled)
    depth, side = 4, 16
    dense = []
    for _ in range(2):
        m = np.zeros(side * side, np.int64)
        m[rng.choice(side * side, filled, replace=False)] = rng.integers(1, 50, filled)
        dense.append(m.reshape(side, side))
    if same:
        dense[1] = dense[0]
    trees = [quadtree.build(*np.nonzero(m), m[np.nonzero(m)], depth) for m in dense]
    sums, zeros = quadtree.pair_sums(*trees, depth, (13, 11), same, lambda i, j, a, b: (a - b) ** 2 + i + 100 * j)
    for i in range(13):
        for j in range(i + 1 if same else 0, 11):
            a, b = dense[0][i], dense[1][j]
            some = (a > 0) | (b > 0)
            assert sums[i, j] == ((a - b) ** 2 + i + 100 * j)[some].sum() and zeros[i, j] == side - some.sum()


def test_frontiers_in_parts_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    m = np.where(rng.random((32, 32)) < 0.4, rng.integers(1, 9, (32, 32)), 0)
    tree = quadtree.build(*np.nonzero(m), m[np.nonzero(m)], 5)
    walk = lambda: quadtree.pair_sums(tree, tree, 5, (32, 32), True, lambda i, j, a, b: a * 7 + b)
    whole = walk()
    monkeypatch.setattr(quadtree, "FRONTIER", 3)
    assert all((x == y).all() for x, y in zip(whole, walk(), strict=True))


def weight(c, n, v):
    return 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_weights_of_large_counts_stay_exact():
    counts, totals = np.array([0, 7, 10**14, 9 * 10**14]), np.array([3, 10**13, 3 * 10**15, 9 * 10**15 - 1])
    assert divergence._weights(counts + 2, totals).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, totals, strict=True)]


@pytest.mark.parametrize("groups", [3, 9])
def test_strips_of_more_groups_than_a_tree_has_rows(monkeypatch, groups):
    monkeypatch.setattr(divergence, "SHALLOW", 2)
    monkeypatch.setattr(divergence, "DEEP", 2)
    rng = np.random.default_rng(groups)
    names, terms = [f"s{i}" for i in range(groups)], 11
    table = np.where(rng.random((terms, groups)) < 0.5, rng.integers(1, 30, (terms, groups)), 0)
    columns = pa.table({"sources": [[names[s] for s in np.nonzero(r)[0]] for r in table], "counts": [r[r > 0].tolist() for r in table]})
    totals = [int(table[:, s].sum()) + 2 * terms for s in range(groups)]
    given = pa.table({"lang": ["x"] * groups, "source": names, "place": list(range(groups)), "total": totals})
    got = {(r["source"], r["other"]): r["value"] for r in divergence.strip_sums(columns, given).to_pylist()}
    for i in range(groups):
        for j in range(i + 1, groups):
            p = [[1 + 10**9 * (int(c) + 2) // totals[s] for c in table[:, s]] for s in (i, j)]
            assert got[names[i], names[j]] == sum((a - b) ** 2 // (a + b) for a, b in zip(*p, strict=True))


def brute(rows):
    docs = [(lang or "", source or "", [t for t in (re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 10]
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if seen[t] >= 10)
        n, v = {s: sum(c.values()) for s, c in counts.items()}, len(kept)
        whole = sum(counts.values(), Counter())
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in counts:
            pairs = [(-sum(apart(weight(counts[s][t], n[s], v), weight(counts[o][t], n[o], v)) for t in kept), o.encode(), o) for o in counts if o != s]
            weights = [(t, weight(counts[s][t], n[s], v), weight(whole[t], sum(n.values()), v)) for t in kept if counts[s][t]]
            terms = [(-apart(p, q), t.encode(), t) for t, p, q in weights if p > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(found, 1)}
    return out


def odd_rows():
    rows = [("en", f"s{i % 3}", f"Common WORD été {'rare' if i % 3 else 'other'} a{chr(97 + i % 5)} {i}") for i in range(60)]
    rows += [("en", None, None), ("en", "empty", ""), (None, None, "İstanbul Kelvin \x00 nul"), (None, "x", "one"), ("de", "lonely", "wort " * 12)]
    rows += [("fr", s, "mot " * k) for s, k in (("a", 5), ("b", 5), ("c", 5))] * 4
    return rows + [("en", "s1", "Common word " * 30_000)] + rows[:5] * 2


def test_odd_rows_against_brute_force_and_sql(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, text, lang, source, 0, "p") for i, (lang, source, text) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, part string")
    got = {tuple(r) for r in divergence.divergence(docs).collect()}
    assert got == brute(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert set(duck.execute(queries.ORACLE_SQL["op13_divergence"]).fetchall()) == got


def test_small_tasks_and_empty_tables(spark, monkeypatch):
    assert [len(list(divergence.words("a b " * 600_000))), sum(map(len, divergence.words("Aé b1c " * 300_000)))] == [3, 900_000]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.divergence(empty).count() == 0
