"""The order of rarity counts every text."""

from collections import Counter

from loomstrand.llm import simhash


def test_common_shingles_count_all_texts(spark):
    texts = [f"the very same five words again and again number {i} of {i % 7}" for i in range(12_000)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    buckets, counts = simhash.common_shingles(docs, 5)
    every = Counter(b for t in texts for b in simhash.bucket_of(simhash.shingle_set(t, 5)[1]).tolist())
    assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == {b: n for b, n in every.items() if n >= 8}
    assert max(counts) >= 12_000 and (buckets[1:] > buckets[:-1]).all()
