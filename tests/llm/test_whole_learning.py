"""What is learned comes from all rows, not from a sample of them."""

import math
import random

from loomstrand.llm import secrets


def test_every_credential_and_every_ordinary_token_is_counted(spark):
    draw = random.Random(7)
    keys = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24)) for _ in range(1_200)]
    long = ["".join(draw.choices("0123456789abcdef", k=90)) for _ in range(30)]
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(30_000)] + ["x" * 1_500]
    rows = [f"secret={k}" for k in keys] * 2 + long + [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    scorer = secrets.learn(docs)
    assert scorer.automata["assign"].totals[scorer.automata["assign"].start] >= 1_200
    assert sum(n for s, n in zip(range(10**6), scorer.automata["hex"].ended, strict=False) if scorer.automata["hex"].same[s] == s) == 30
    for kind, least in scorer.threshold.items():
        ordered = sorted((scorer.ratio(kind, secrets.shape(w)) for w in set(words)), reverse=True)
        above = ordered[int(secrets.ERROR * len(ordered))]
        assert least == max(secrets.MARGIN, math.nextafter(above, math.inf))


def test_the_rank_is_exact_whatever_the_driver_may_hold(spark, monkeypatch):
    draw = random.Random(3)
    scores = [(round(draw.gauss(0, 5), draw.choice([0, 3, 9])), draw.randint(1, 4)) for _ in range(5_000)]
    rows = spark.createDataFrame(scores, "score double, n long")
    ordered = sorted((s for s, n in scores for _ in range(n)), reverse=True)
    for held in (10_000, 3):
        monkeypatch.setattr(secrets, "HELD_SCORES", held)
        assert [secrets.reached(rows, k) for k in (0, 12, len(ordered) - 1)] == [ordered[0], ordered[12], ordered[-1]]
