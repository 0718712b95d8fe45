import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomstrand.llm import components, neighbours, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, distance):
    label = list(range(len(codes)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance) + i + 1:
            label[max(top(i), top(int(j)))] = min(top(i), top(int(j)))
    return [top(i) for i in range(len(codes))]


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \t\n", "One", "one TWO three", "a b c d", "É é À b c\x0bd e", "x " * 50, "a\x85b c\xa0d e f", "Straße İstanbul ſ K one two"]:
        assert int(simhash.majority(simhash.shingle_hashes(text or ""))[0]) == brute_fingerprint(text), text


@pytest.mark.parametrize("seed", range(4))
def test_index_links_what_brute_force_links(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 7), replace=False)) for b in np.repeat(base, 12)]
    codes = np.unique(np.array(flips, dtype=np.uint64))
    expected = brute_components(codes, 4)
    label = list(range(len(codes)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for _, mask in simhash.band_masks(0):
        shared = codes & np.array(mask, dtype=np.int64).view(np.uint64)
        order = np.lexsort((simhash.gray_rank(codes ^ shared), shared))
        group = np.cumsum(np.r_[False, shared[order][1:] != shared[order][:-1]])
        a, b = simhash.GrayIndex(codes[order][:, None], group).links(4)
        assert (np.bitwise_count(codes[order[a]] ^ codes[order[b]]) <= 4).all()
        for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True):
            label[max(top(x), top(y))] = min(top(x), top(y))
    assert [top(i) for i in range(len(codes))] == expected


def test_more_bands_keep_the_pigeonhole():
    for count in (10, 10**8, 10**12):
        masks = [m & (2**64 - 1) for _, m in simhash.band_masks(count)]
        for flipped in ([0, 13, 26, 39], [1, 2, 3, 4], [12, 25, 38, 63]):
            error = sum(1 << b for b in flipped)
            assert any(not m & error for m in masks)


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def corpus():
    draw = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(draw.choice(words, 60)) for _ in range(40)]
    out = []
    for i, t in enumerate(texts):
        parts = t.split()
        out += [t] * (6 if i == 0 else 1)
        changed = list(parts)
        changed[int(draw.integers(60))] = "changed"
        out.append(" ".join(changed))
    return [*out, None, "", "", "two words"]


def test_simhash_groups_against_brute_force(spark):
    texts = corpus()
    rows = [(i * 3 + 1, t, 1, "x") for i, t in enumerate(texts)] + [(1, texts[0], 1, "x"), (None, texts[0], 1, "x"), (None, "alone without an id", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, code string")
    found = simhash.simhash_groups(df).collect()
    codes = np.array([brute_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    groups = defaultdict(list)
    for r, g in zip(rows, brute_components(codes, 4), strict=True):
        groups[g].append(r[0])
    expected = sorted((str(r[0]), f"{int(c):016x}", str(min((i for i in groups[g] if i is not None), default=None))) for r, c, g in zip(rows, codes, brute_components(codes, 4), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def test_deduplicated_keeps_one_of_each_group_of_similar_texts(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[0], "x")], "doc_id long, text string, kept string")
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    kept = simhash.deduplicated(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(label)) and [r.text for r in kept if r.doc_id is None] == [texts[0]]
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (5, 5), (1, 2)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 202: 200}


def vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=16).tolist(), 1) for i in range(900)]
    same = draw.normal(size=16).tolist()
    rows += [(1000 + i, same, 2) for i in range(60)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [1.0, None] * 8, 0), (2080, [], 0), (2100, [float("inf")] * 16, 0), (2120, [1.0, 2.0], 0), (2121, [3.0, 1.0], 0), (0, rows[0][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def test_neighbours_recall_order_and_ties(spark):
    rows, df = vectors(spark)
    found = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, block=300, queries=20).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: np.array(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        exact = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:20]
        got = sorted(found.pop(q))
        assert [r for r, _, _ in got] == list(range(1, len(exact) + 1))
        assert all(abs(float((good[q] * good[i]).sum()) - s) < 1e-12 for _, i, s in got)
        hit, total = hit + len({i for _, i, _ in got} & {i for _, i in exact}), total + len(exact)
    assert hit / total >= 0.97 and not found
    best = neighbours.nearest(df, F.col("vec_id") == 1040, k=20).collect()
    assert sorted(r.vec_id for r in best) == list(range(1000, 1020))


def test_neighbours_of_nothing(spark):
    _, df = vectors(spark)
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") < 0).count() == 0


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def edited_families():
    """Chains and dense groups of edited copies at similarities around 0.8, one common passage, and rows that repeat or lack an id."""
    draw = np.random.default_rng(11)
    words = [f"w{i}" for i in range(5000)]
    passage = draw.choice(words, 30).tolist()
    rows = []

    def put(parts):
        rows.append((len(rows), " ".join(parts)))

    for family in range(40):
        base = draw.choice(words, int(draw.integers(40, 160))).tolist()
        held = [base]
        for _ in range(12):
            parts = list(held[-1] if family % 2 else base)
            for _ in range(max(1, round(len(parts) * float(draw.uniform(0.01, 0.035))))):
                parts[int(draw.integers(len(parts)))] = f"n{int(draw.integers(10**9))}"
            held.append(parts)
        for parts in held:
            put(parts)
    for _ in range(60):
        put(passage + draw.choice(words, int(draw.integers(10, 40))).tolist())
    rows.append((0, rows[100][1]))
    rows += [(None, rows[i][1] + " and so on") for i in range(0, 200, 9)]
    return [rows[int(i)] for i in draw.permutation(len(rows))]


def test_similar_groups_are_those_of_brute_force(spark):
    rows = edited_families()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = list(range(len(rows)))
    for i, j in pairs:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label] if a != b else label
    least = {g: min((r[0] for r, x in zip(rows, label, strict=True) if x == g and r[0] is not None), default=None) for g in set(label)}
    expected = sorted((str(r[0]), str(least[g])) for r, g in zip(rows, label, strict=True))
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == expected
