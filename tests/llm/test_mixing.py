import math

import pytest
from aerolith.llm import mixing

DOCS = "doc_id bigint, source string, text string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def made(spark, sizes):
    rows, i = [], 0
    for source, n, words in sizes:
        for j in range(n):
            rows.append((i := i + 1, source if j % 3 else f" {source.upper()}\t" if source else None, "word " * (words + j % 7), "x"))
    return spark.createDataFrame(rows, DOCS)


def shares(docs, targets, **kw):
    mixed, plan = mixing.mixture(docs, targets, **kw)
    return {r.source: r for r in mixing.report(mixed, plan).collect()}, mixed


def test_shares_are_reached(spark):
    docs = made(spark, [("a", 600, 20), ("b", 300, 30), ("c", 60, 10), (None, 50, 10), ("other", 50, 5)])
    targets = spark.createDataFrame([("A", 0.5, 1), ("b ", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 2)], TARGETS)
    got, mixed = shares(docs, targets)
    for k, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert got[k].share == pytest.approx(want, rel=0.02) and got[k].most_copies <= got[k].max_repeats
    assert got["none"].share == 0 and "other" not in got
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    again = shares(docs.repartition(5), targets)[1]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_caps_and_a_given_total(spark):
    docs = made(spark, [("a", 50, 20), ("b", 50, 20)])
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1)], TARGETS)
    got, mixed = shares(docs, targets, total=1e6)
    assert {r.copies for r in mixed.where("source = 'a'").collect()} == {2} and {r.copies for r in mixed.where("source = 'b'").collect()} == {1}
    half, _ = shares(docs, targets, total=got["b"].tokens_there * 4.0)
    assert half["b"].tokens == pytest.approx(half["b"].goal_tokens, abs=30) and half["a"].goal_tokens == 2 * half["a"].tokens_there


def test_rates_are_tilted_and_meet_the_token_constraint(spark):
    """Against the dual solved by bisection over the documents themselves; caps are in it."""
    docs = made(spark, [("a", 300, 3), ("b", 200, 2), ("c", 50, 9)])
    sized = mixing.measured(docs, "doc_id", "text", "source")
    tokens = {}
    for r in sized.collect():
        tokens.setdefault(r.source, []).append(r.tokens)
    goals = {"a": (1.0, 0.4), "b": (3.0, 2.2), "c": (2.0, 2.0)}
    s = {k: mixing.Source(1 / 3, cap, len(tokens[k]), sum(tokens[k]), sum(tokens[k]) * part) for k, (cap, part) in goals.items()}
    assert mixing.balanced(sized, s) > 0
    for k, (cap, _) in goals.items():
        mean = s[k].tokens / s[k].documents
        rate = lambda t, b: min(cap, math.exp(min(50.0, b * t / mean)))  # noqa: B023, E731
        if k == "c":
            assert s[k].b == math.inf
        else:
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(rate(t, mid) * t for t in tokens[k]) < s[k].goal else (low, mid)
            assert s[k].b == pytest.approx(low, abs=1e-6)
        assert sum(rate(t, s[k].b) * t for t in tokens[k]) == pytest.approx(s[k].goal, rel=1e-8)
    out = mixing.copies(sized, s, "doc_id").collect()
    rates = sorted({(r.tokens, round(r.rate, 9)) for r in out if r.source == "a"})
    assert len({r for _, r in rates}) > 1 and [r for _, r in rates] == sorted((r for _, r in rates), reverse=True)  # shrinking: long ones less
    grown = [r for _, r in sorted({(r.tokens, round(r.rate, 9)) for r in out if r.source == "b"})]
    assert len(set(grown)) > 1 and grown == sorted(grown) and max(grown) <= 3  # growing: long ones more, to the cap
    for k in goals:
        assert sum(r.tokens * r.copies for r in out if r.source == k) == pytest.approx(s[k].goal, abs=max(tokens[k]) / 2 + 1)


def test_a_dual_that_is_not_solved_raises(spark):
    docs = made(spark, [("a", 90, 3)])
    sized = mixing.measured(docs, "doc_id", "text", "source")
    s = {"a": mixing.Source(1.0, 1.0, sized.count(), sized.groupBy().sum("tokens").first()[0])}
    s["a"].goal = s["a"].tokens * 0.4
    with pytest.raises(mixing.Unsolved):
        mixing.balanced(sized, s, steps=1)


def test_nothing(spark):
    docs = made(spark, [("a", 3, 1)])
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    got, mixed = shares(docs.limit(0), targets)
    assert mixed.count() == 0 and got["a"].share == 0
    assert shares(docs, targets.limit(0))[1].count() == 0
