import math
import random
from collections import Counter

from metaveil.llm import mixing
from tests.llm.cases import documents, frame, odd_texts


def test_every_document_and_the_weights(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"s{i % 30}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    assert {r.doc_id for r in got} == set(range(900))
    tokens, budgets = Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        budgets[r.source] = r.weight
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - w) < 0.02 for s, w in budgets.items())
    for s in budgets:  # starts follow each other without a gap
        mine = sorted((r.start, r.n_tokens) for r in got if r.source == s)
        assert all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    again = Counter(r.doc_id for r in mixing.realise(docs).collect())
    assert again == Counter(r.doc_id for r in got)


def test_odd_rows(spark):
    assert mixing.mixture(documents(spark)).count() >= len(odd_texts())
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert mixing.realise(frame(spark, [])).count() == 0


def brute_exponent(tokens, target):
    """By halving, one exponent at a time."""
    total = sum(tokens)

    def powers(a):
        return [(t / total) ** a for t in tokens]

    def entropy(a):
        z = sum(powers(a))
        return -sum(p / z * math.log(p / z) for p in powers(a))

    def repeats(a):
        z = sum(powers(a))
        passes = [p / z * total / t for p, t in zip(powers(a), tokens)]
        return max(passes) * target.budget / total if target.budget else max(passes) / min(passes)

    def border(holds_low):
        low, high = 0.0, 1.0
        if holds_low(1.0):
            return 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds_low(middle) else (low, middle)
        return low

    return max(border(lambda a: entropy(a) >= target.entropy * math.log(len(tokens))), border(lambda a: repeats(a) > target.max_epochs))


def test_exponent_weights_and_passes_against_brute_force(spark):
    rng = random.Random(6)
    for target in (mixing.Target(), mixing.Target(entropy=0.97), mixing.Target(entropy=0.99, max_epochs=2.0), mixing.Target(budget=30_000, max_epochs=3.0)):
        sizes = [rng.randrange(1, 40) ** 2 for _ in range(6)]
        docs = spark.createDataFrame([(s * 1000 + i, "w " * (1 + i % 3), f"s{s}") for s, n in enumerate(sizes) for i in range(n)], "doc_id long, text string, source string")
        tokens = [sum(1 + i % 3 for i in range(n)) for n in sizes]
        planned = {r.key: r for r in mixing.plan(mixing._counted(docs), target).collect()}
        a = brute_exponent(tokens, target)
        z = sum((t / sum(tokens)) ** a for t in tokens)
        budget = target.budget or max(t / ((t / sum(tokens)) ** a / z) for t in tokens)
        for s, t in enumerate(tokens):
            weight = (t / sum(tokens)) ** a / z
            row = planned[f"=s{s}"]
            assert abs(row.weight - weight) < 1e-5
            assert row.full == math.floor(weight * budget / t + 1e-6) or abs(weight * budget / t - round(weight * budget / t)) < 1e-4


def test_clashing_names(spark):
    docs = frame(spark, [(1, "a b"), (2, "c")]).withColumnsRenamed({"fp": "mix", "salt": "copy"})
    assert mixing.realise(docs).columns == docs.columns
