"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstrand.llm.common import fold_of, table

ORACLE_SQL: dict[str, str] = {
    "op11_merkle": r"""
with recursive f as (select *, coalesce(cast(doc_id as varchar), '') as key from documents),
c as (select *, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda k: ascii(key[k])::bigint)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) % 2 = 1 as tampered from f),
d as (select doc_id, coalesce('s' || source, '') as tree, text, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
    case when tampered then replace(text, chr(10), '') else text end as now from c),
leaf as (select doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as h, sha256(head || coalesce(strlen(now) || ':' || now, '-')) as g from d),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i, count(*) over (partition by tree) as n from leaf),
nodes(tree, level, i, h, n) as (select tree, 0, i, h, n from placed
    union all select tree, level + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from nodes where n > 1 group by tree, level, i // 3),
sib as (select tree, level, i, h, n, coalesce(string_agg(h, '') over (partition by tree, level, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(h, '') over (partition by tree, level, i // 3 order by i rows between 1 following and unbounded following), '') as after from nodes),
tops as (select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
over_(level, i, h, n) as (select 0, i, h, n from tops
    union all select level + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from over_ where n > 1 group by level, i // 3),
sib2 as (select level, i, h, n, coalesce(string_agg(h, '') over (partition by level, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(h, '') over (partition by level, i // 3 order by i rows between 1 following and unbounded following), '') as after from over_),
fold(tree, r, level, i, cur, proof) as (select tree, i, 0, i, g, '' from placed
    union all select fold.tree, fold.r, fold.level + 1, fold.i // 3, sha256(before || cur || after), proof || before || after
    from fold join sib on sib.tree = fold.tree and sib.level = fold.level and sib.i = fold.i where sib.n > 1),
below as (select fold.tree, fold.r, fold.cur, fold.proof, tops.h as subroot, tops.i from fold join sib on sib.tree = fold.tree and sib.level = fold.level and sib.n = 1 join tops on tops.tree = fold.tree),
fold2(tree, r, level, i, cur, proof, subroot) as (select tree, r, 0, i, cur, proof, subroot from below
    union all select tree, r, fold2.level + 1, fold2.i // 3, sha256(before || cur || after), proof || before || after, subroot
    from fold2 join sib2 on sib2.level = fold2.level and sib2.i = fold2.i where sib2.n > 1)
select doc_id, placed.h as leaf, subroot, sib2.h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = sib2.h as verified
from fold2 join sib2 on sib2.level = fold2.level and sib2.n = 1 join placed on placed.tree = fold2.tree and placed.i = fold2.r""",
    "op13_divergence": r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms,
    row_number() over () as r from documents),
w as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(terms) as term from d) group by all),
v as (select lang, term from w group by lang, term having count(distinct r) >= 10),
g as (select distinct lang, source from d),
vs as (select g.lang, count(distinct v.term) as v from (select distinct lang from g) g left join v using (lang) group by g.lang),
c as (select g.lang, g.source, v.term, coalesce(k.n, 0) as n from g join v using (lang) left join
    (select lang, source, term, sum(n) as n from w group by all) k using (lang, source, term)),
t as (select lang, source, sum(n) as total from c group by all),
p as (select c.lang, c.source, c.term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (t.total + 2 * vs.v) as p from c join t using (lang, source) join vs using (lang)),
l as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) as q
    from c join vs using (lang) join (select lang, sum(total) as total from t group by lang) using (lang) group by lang, term),
pairs as (select a.lang, a.source, b.source as item from g a join g b on a.lang = b.lang and a.source <> b.source),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select pairs.lang, pairs.source, 'pair' as part, pairs.item, coalesce(f.value, 0) as value from pairs left join f using (lang, source, item)
    union all
    select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p join l using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value,
    cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from o qualify part = 'pair' or rank <= 10""",
}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    import public_tokenizers

    from loomstrand.llm.packing import best_fit_pack

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from loomstrand.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    from loomstrand.llm.quality import KEPT_FROM, quality_scores

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scores = quality_scores(table(spark, sf_dir, "documents"), labels, fold_of(F.col("doc_id")) != 0)
    return scores.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the rows."""
    from loomstrand.llm.language import identify

    found = identify(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) != 0)
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose row counts are at most one apart."""
    from loomstrand.llm.sharding import bounded_ring

    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = bounded_ring(docs, 8, text="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))



def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    from loomstrand.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)



def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from loomstrand.llm.html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))



def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    from loomstrand.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))



def _only(kind: str):
    """A step that keeps this kind and turns others into null."""
    return lambda k: F.when(k == kind, k)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base spans, and all spans."""
    from loomstrand.llm.secrets import KINDS, scan

    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    counts = [F.size(F.array_compact(F.transform("base.kind", _only(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))



def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    from loomstrand.llm.surrogates import surrogates

    return surrogates(table(spark, sf_dir, "documents"), b"a key that production takes from its vault")



def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    import public_tokenizers

    from loomstrand.llm.pieces import encoded

    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )



def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    from loomstrand.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))



def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what it folds to where line ends were lost."""
    from loomstrand.llm.merkle import audited

    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    found = audited(table(spark, sf_dir, "documents"), lambda text: F.when(tampered, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")



QUERIES = {
    "op1_packing": op1_packing,
    "op2_surrogates": op2_surrogates,
    "op3_secrets": op3_secrets,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_neighbours": op9_neighbours,
    "op10_main_text": op10_main_text,
    "op11_merkle": op11_merkle,
    "op12_pieces": op12_pieces,
    "op13_divergence": op13_divergence,
}
