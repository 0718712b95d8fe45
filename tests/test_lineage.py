"""Records of replacements, and what is behind them."""

import random

from pyspark.sql import functions as F

from loomstrand.operators import lineage
from loomstrand.sources import logs

LOG = f"session_id long, seq long, type string, reason string, source_kind string, covers array<long>, shadowed array<long>, record {lineage.RECORD}, parts array<string>"


def node(seq, covers=(), kind="user/message", source="checkpoint", session=1):
    return (session, seq, kind, None, source if covers else None, list(covers), None, None, None)


def pruned(spark, **changes):
    """A result, its price and its replacement with a record that is right but for `changes`; gives the fault."""
    fields = {"producer": "loomstrand", "schema_version": 1, "kind": "tool-pruned", "covered": [0], "sources": [0], "group_id": None, "generation": 1}
    parts = changes.pop("parts", ["cut"])
    price = changes.pop("price", 1)
    fields |= {k: v for k, v in changes.items() if k in fields}
    columns = [F.lit(fields["kind"]), F.lit(fields["covered"]).cast("array<long>") if fields["covered"] else F.array().cast("array<long>"), F.array(*map(F.lit, fields["sources"])), F.lit(fields["group_id"]).cast("string"), F.lit(fields["generation"]), F.array(*map(F.lit, parts))]
    digest = spark.range(1).select(lineage.record_digest(*columns)).first()[0]
    record = (*fields.values(), changes.get("digest", digest))
    rows = [node(0, kind="tool/result"), (1, price, "compaction/prune", None, None, [], changes.get("shadowed", [0]), record, None), (1, 2, "tool/result", None, None, [0], None, None, changes.get("said", parts))]
    found = lineage.read_back(spark.createDataFrame(rows, LOG)).collect()
    return found[0].fault


def test_every_field_of_a_record_is_read_back(spark):
    assert pruned(spark) is None and pruned(spark, kind="tool-summary", group_id="g") is None
    faults = [
        ({"price": 5}, "no-price"), ({"producer": "x"}, "foreign-producer"), ({"schema_version": 2}, "unknown-version"), ({"kind": "x"}, "unknown-kind"), ({"covered": []}, "malformed-seqs"),
        ({"sources": [-1]}, "malformed-seqs"), ({"shadowed": None}, "malformed-seqs"), ({"shadowed": [0, 0]}, "other-range"), ({"sources": [1]}, "uncited-cover"), ({"sources": [0, 2]}, "later-or-repeated-source"),
        ({"sources": [0, 0]}, "later-or-repeated-source"), ({"group_id": "g"}, "wrong-group"), ({"kind": "tool-summary"}, "wrong-group"), ({"generation": 2}, "wrong-generation"), ({"generation": -1}, "wrong-generation"),
        ({"digest": "x"}, "stale-digest"), ({"said": ["other"]}, "stale-digest"), ({"said": None}, "stale-digest"), ({"parts": ["a", "b"], "said": ["a\",\"b"]}, "stale-digest"),
    ]
    for change, fault in faults:
        assert pruned(spark, **change) == fault, change


def test_fingerprints_tell_groups_apart(spark):
    row = lambda life, seqs, calls, parts: F.struct(lineage.group_fingerprint(F.lit(life), F.array(*map(F.lit, seqs)), F.array(*map(F.lit, calls)), F.array(F.lit("tool/result")), F.array(*map(F.lit, parts)))).alias("f")
    cases = [(1, [1, 23], ["a"], ["x"]), (2, [1, 23], ["a"], ["x"]), (1, [12, 3], ["a"], ["x"]), (1, [1, 23], ["b"], ["x"]), (1, [1, 23], ["a"], ["x", ""]), (1, [1, 23], ["a"], ["x"])]
    found = [spark.range(1).select(row(*c)).first()[0][0] for c in cases]
    assert len(set(found)) == 5 and found[0] == found[5] and len(found[0]) == 64


def brute(rows):
    """(seq, origin, proven) by walking down from each replacement."""
    covers = {r[1]: [c for c in r[5] if c < r[1]] for r in rows if r[5]}
    known = {r[1]: r[2] == "user/message" for r in rows}
    out = {}

    def walk(top, at, proven):
        for c in covers[at]:
            way = proven and known[at]
            if c in covers:
                walk(top, c, way)
            else:
                out[top, c] = out.get((top, c), False) or way

    for seq in covers:
        walk(seq, seq, True)
    return {(s, o, p) for (s, o), p in out.items()}


def got(spark, rows):
    kinds = lineage.source_kinds(spark.createDataFrame(rows, LOG))
    return {(r.seq, r.origin, r.proven) for r in lineage.origins(kinds).collect()}


def test_origins_of_shared_citations(spark):
    rng, rows = random.Random(4), [node(i) for i in range(12)]
    for seq in range(12, 40):
        kind = rng.choice(["user/message", "user/message", "tool/result"])
        rows.append(node(seq, rng.sample(range(max(0, seq - 14), seq), rng.randint(1, 3)) + ([seq + 3] if seq % 7 == 0 else []), kind))
    assert got(spark, rows) == brute(rows)


def test_a_deep_chain_and_a_hub(spark):
    chain = [node(0), node(1)] + [node(i, [i - 1] if i > 2 else [0, 1]) for i in range(2, 202)]
    found = got(spark, chain)
    assert found == {(i, o, True) for i in range(2, 202) for o in (0, 1)}
    hub = [node(i) for i in range(5_000)] + [node(5_000, range(5_000))] + [node(5_001 + i, [5_000 + i]) for i in range(3)]
    found = got(spark, hub)
    assert len(found) == 20_000 and {s for s, _, _ in found} == {5_000, 5_001, 5_002, 5_003}


def test_logs_without_replacements_and_claims_that_conflict(spark):
    assert got(spark, [node(0), node(1)]) == set()
    assert lineage.replacement_coverage(spark.createDataFrame([], LOG)).count() == 0
    log = logs.provenance_log(spark, "/root/testdata/sf0.001")
    plain = {(r.session_id, r.seq): r.kind for r in lineage.source_kinds(log).where("covered is not null").collect()}
    everything = log.where("size(covers) > 0").select("session_id", "seq")
    claimed = {(r.session_id, r.seq): r.kind for r in lineage.source_kinds(log, everything.unionByName(everything)).where("covered is not null").collect()}
    assert claimed.keys() == plain.keys() and set(plain.values()) == {"tool-summary", "tool-pruned", "unknown-replacement", "history-summary"}
    assert all(claimed[k] == ("unknown-replacement" if plain[k] == "tool-pruned" else plain[k]) for k in plain)
    assert lineage.read_back(log).select("fault").distinct().count() == 12
