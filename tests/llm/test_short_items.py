"""Benchmark items of few words with one edit."""

import random

from loomstrand.llm.common import table
from loomstrand.llm.decontaminate import SHORT, BlockMaxIndex, words_of

SF = "/root/testdata/sf0.1"


def edits(words, rng):
    i = rng.randrange(len(words))
    yield [*words[:i], "zzchanged", *words[i + 1 :]]
    yield [*words[:i], *words[i + 1 :]]
    yield [*words[:i], "zzadded", *words[i:]]


def test_every_one_word_edit_of_a_short_item_is_found_and_clean_texts_are_not(spark):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect() if r.text]
    index = BlockMaxIndex(items)
    rng, tried, missed = random.Random(1), 0, []
    filler = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(20).collect()]
    clean = [set(index.matches(f)) for f in filler]
    for k, (item_id, text) in enumerate(items):
        words = words_of(text.lower())
        if not SHORT[0] <= len(words) <= SHORT[1]:
            continue
        for changed in edits(words, rng):
            tried += 1
            around = filler[k % len(filler)][:400]
            if k not in index.matches(f"{around} {' '.join(changed)} {around}"):
                missed.append((item_id, len(words)))
    assert tried and len(missed) <= tried * 0.02, (len(missed), tried, missed[:5])
    # Nothing is found by order alone in texts that hold no item by shingles.
    by_shingles = [{i for i, (_, _, _, shared) in index.matches(f).items() if shared >= 0.8} for f in filler]
    assert clean == by_shingles


def test_order_counts_only_near_by(spark):
    words = "what is the capital city of france . it is paris on the seine".split()
    index = BlockMaxIndex([(1, " ".join(words)), (2, "another item about something else entirely . yes of course")])
    assert index.in_order(0, words) == 1.0
    far = [w for word in words for w in (word, "x", "y", "z")]
    assert index.in_order(0, far) < 0.5 and index.in_order(0, list(reversed(words))) < 0.5 and index.in_order(0, []) == 0.0
