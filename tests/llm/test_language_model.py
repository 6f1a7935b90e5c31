import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparklith.llm import lm
from sparklith.llm.storage import Workspace

from .helpers import prose, rng, words

TEXTS = ["The cat sat on the mat.", "the dog sat on the log", None, "", "the cat ran", "a a a a b a a", "THE END"]


class Plain:
    """The model from dictionaries."""

    def __init__(self, texts):
        docs = [[*words(t, lower=True), None] for t in texts]
        self.count = Counter(w for d in docs for w in d)
        pairs = Counter(p for d in docs for p in zip(["<", *d], d))
        self.pairs, self.by = pairs, defaultdict(dict)
        for (u, w), c in pairs.items():
            self.by[u][w] = c
        self.before = Counter(w for _, w in pairs)
        self.d2, self.d1 = self.discount(pairs.values()), self.discount(self.before.values())
        self.n, self.v = sum(self.count.values()), len(self.count)

    @staticmethod
    def discount(counts):
        n = Counter(counts)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k
            out.append(min(max(d, 0.05), k - 0.05))
        return out

    def lower(self, w):
        total, c = sum(self.before.values()), self.before.get(w, 0)
        rest = sum(self.d1[min(x, 3)] for x in self.before.values()) / total
        return max(c - self.d1[min(c, 3)], 0) / total + rest / (self.v + 1)

    def p(self, u, w):
        have = self.by.get(u)
        if not have:
            return self.lower(w)
        total, c = sum(have.values()), have.get(w, 0)
        rest = sum(self.d2[min(x, 3)] for x in have.values()) / total
        return max(c - self.d2[min(c, 3)], 0) / total + rest * self.lower(w)

    def score(self, t):
        d = [*words(t, lower=True), None]
        return (
            len(d),
            sum(w in self.count for w in d),
            sum(math.log10((self.count.get(w, 0) + 1) / (self.n + self.v + 1)) for w in d),
            sum(math.log10(self.p(u, w)) for u, w in zip(["<", *d], d)),
        )


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as shard", "'c' as k")


@pytest.mark.parametrize("shard_tokens", [1 << 23, 40])
def test_agrees_with_dictionaries(spark, shard_tokens, monkeypatch):
    rnd = rng(5)
    texts = TEXTS + [prose(rnd, rnd.randrange(80), 60) for _ in range(40)] + ["the " * 3000]
    unseen = ["zebra cat the", "zebra zebra", "w1 w2 unseen w3", None]
    if shard_tokens == 40:
        monkeypatch.setattr(lm, "HELD", 50)
    model = lm.learn(spark, frame(spark, texts).repartition(3), Workspace(spark, "lm"), shard_tokens)
    plain = Plain(texts)
    assert (model.total, model.types) == (plain.n, plain.v) and (model.bits > 0) == (shard_tokens == 40)
    got = sorted(map(tuple, lm.scores(spark, frame(spark, texts + unseen), model).collect()))
    for row, t in zip(got, texts + unseen):
        want = plain.score(t)
        assert row[1:3] == want[:2]
        assert row[3:] == pytest.approx(want[2:], rel=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(TEXTS)
    for u in ["<", "the", "a", "cat", "never seen"]:
        assert sum(plain.p(u, w) for w in plain.count) + plain.p(u, "unknown word") == pytest.approx(1)


class PlainTriples(Plain):
    """Order 3 from dictionaries."""

    def __init__(self, texts):
        super().__init__(texts)
        docs = [["<", *words(t, lower=True), None] for t in texts]
        self.triples = Counter(x for d in docs for x in zip(d, d[1:], d[2:]))
        self.after = defaultdict(dict)
        for (t, u, w), c in self.triples.items():
            self.after[t, u][w] = c
        kinds = Counter((u, w) for _, u, w in self.triples)
        for u, w in self.pairs:
            self.by[u][w] = self.pairs[u, w] if u == "<" else kinds[u, w]
        self.d3, self.d2 = self.discount(self.triples.values()), self.discount(c for x in self.by.values() for c in x.values())

    def p3(self, t, u, w):
        have = self.after.get((t, u))
        if not have:
            return self.p(u, w)
        total, c = sum(have.values()), have.get(w, 0)
        rest = sum(self.d3[min(x, 3)] for x in have.values()) / total
        return max(c - self.d3[min(c, 3)], 0) / total + rest * self.p(u, w)

    def score(self, t):
        d = ["<", *words(t, lower=True), None]
        return *super().score(t)[:3], math.log10(self.p("<", d[1])) + sum(math.log10(self.p3(*x)) for x in zip(d, d[1:], d[2:]))


@pytest.mark.parametrize("shard_tokens", [1 << 23, 40])
def test_order_3_agrees_with_dictionaries(spark, shard_tokens, monkeypatch):
    rnd = rng(6)
    texts = TEXTS + [prose(rnd, rnd.randrange(80), 12) for _ in range(40)] + ["the " * 3000]
    unseen = ["zebra cat the", "zebra zebra", "w1 w2 unseen w3 w4 w5", "the cat sat", None]
    if shard_tokens == 40:
        monkeypatch.setattr(lm, "HELD", 50)
    model = lm.learn(spark, frame(spark, texts).repartition(3), Workspace(spark, "lm"), shard_tokens, order=3)
    plain = PlainTriples(texts)
    for u in [("<", "the"), ("the", "cat"), ("w1", "w2"), ("the", "the"), ("never", "seen")]:
        assert sum(plain.p3(*u, w) for w in plain.count) + plain.p3(*u, "unknown word") == pytest.approx(1)
    got = sorted(map(tuple, lm.scores(spark, frame(spark, texts + unseen), model).collect()))
    for row, t in zip(got, texts + unseen):
        want = plain.score(t)
        assert row[1:3] == want[:2]
        assert row[3:] == pytest.approx(want[2:], rel=1e-9)
    empty = lm.learn(spark, frame(spark, TEXTS).limit(0), Workspace(spark, "lm"), order=3)
    assert all(math.isfinite(r["score"]) for r in lm.scores(spark, frame(spark, TEXTS), empty).collect())


def test_query_is_better_than_order_2(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = lm.scores(spark, docs, lm.learn(spark, docs.where(~lm.held_out("doc_id", 7, 2)), Workspace(spark, "lm")))
    query = lm.op5_kneser_ney(spark, "/root/testdata/sf0.01").where("held_out")
    both = query.join(pairs.selectExpr("doc_id", "score as other"), "doc_id").selectExpr("sum(score) as a", "sum(other) as b", "sum(n_tokens) as n").first()
    assert both.a > both.b + 0.05 * both.n


def test_nothing_to_learn_from(spark):
    model = lm.learn(spark, frame(spark, TEXTS).limit(0), Workspace(spark, "lm"))
    assert (model.total, model.types) == (0, 0)
    got = lm.scores(spark, frame(spark, TEXTS), model).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.scores(spark, frame(spark, []), model).count() == 0


def test_keys_are_packed_without_loss():
    rnd = np.random.default_rng(1)
    for k in (np.zeros(0, np.uint64), np.unique(rnd.integers(0, 2**64, 500, dtype=np.uint64)), np.array([0, 2**32 - 1, 2**33, 2**64 - 1], np.uint64)):
        assert (lm.unsqueeze(*lm.squeeze(k)) == k).all()


def test_query_is_better_than_the_base(spark):
    df = lm.op5_kneser_ney(spark, "/root/testdata/sf0.01").toPandas()
    held = df[df.held_out]
    assert held.score.sum() > held.base_score.sum() + 0.3 * held.n_tokens.sum()
    assert df.train_tokens.unique().tolist() == [int(df[~df.held_out].n_tokens.sum())]
