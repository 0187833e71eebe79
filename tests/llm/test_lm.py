import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sievelake.llm import lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return [w.lower() if w.isascii() else w for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


class Brute:
    """The same model with dictionaries, by recursion on ever shorter contexts."""

    def __init__(self, texts, share, d):
        docs = [["<s>", *w] for w in map(split, texts) if w]
        c1 = Counter(w for x in docs for w in x[1:])
        n = sum(c1.values())
        keep = lambda c: {k: v for k, v in c.items() if v >= share * n}
        self.n, self.kinds = n, len(c1)
        self.c1 = keep(c1)
        voc = set(self.c1) | {"<s>"}
        self.c2 = keep(Counter(p for x in docs for p in zip(x, x[1:]) if set(p) <= voc))
        self.c3 = keep(Counter(t for x in docs for t in zip(x, x[1:], x[2:]) if t[:2] in self.c2 and t[1:] in self.c2))
        self.ctx = {**{(w,): c for w, c in self.c1.items()}, ("<s>",): len(docs), **self.c2}
        self.d, self.next = d, {}
        for g in [*self.c2, *self.c3]:
            self.next.setdefault(g[:-1], []).append(g[-1])

    def p(self, h, w):
        if not h:
            return self.c1[w] / (self.n + 1) if w in self.c1 else (self.n - sum(self.c1.values()) + 1) / (self.n + 1) / (self.kinds - len(self.c1) + 1)
        count = {**self.c2, **self.c3}.get((*h, w))
        if count:
            return (count - self.d) / self.ctx[h]
        seen = self.next.get(h, [])
        if not seen:
            return self.p(h[1:], w)
        left = 1 - sum(self.p(h, v) for v in seen)
        return left / (1 - sum(self.p(h[1:], v) for v in seen)) * self.p(h[1:], w)

    def score(self, text):
        x, total = ["<s>", *split(text)], 0.0
        for i in range(1, len(x)):
            total += math.log(self.p(tuple(x[max(0, i - 2) : i]), x[i]))
        return total


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "Of", "é", "漢字"] + [f"w{i}" for i in range(30)]
    return [" ".join(rng.choice(vocab[: rng.choice([4, 34])]) for _ in range(rng.choice([0, 1, 2, 15, 60]))) for _ in range(40)]


@pytest.mark.parametrize("share", [1e-9, 0.004])
def test_against_brute_force(spark, share):
    texts = corpus(2)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    brute = Brute(texts, share, lm.DISCOUNT)
    got = lm.score_documents(docs, min_share=share).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.tokens == len(split(texts[r.doc_id]))
        assert r.log_probability == pytest.approx(brute.score(texts[r.doc_id]), abs=1e-6)
        assert r.perplexity is None if not r.tokens else r.perplexity == pytest.approx(math.exp(-r.log_probability / r.tokens))


def test_probabilities_add_up(spark):
    texts = corpus(3)
    model = lm.fit_automaton(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA), min_share=0.003)
    words = sorted({w for t in texts for w in split(t)})
    for context in (["the"], ["w1", "of"], ["é", "the"], []):
        lead = model.score(pa.array([" ".join(context)]))[0][0]
        each = model.score(pa.array([" ".join([*context, w]) for w in [*words, "novel"]]))[0]
        assert np.exp(each - lead).sum() == pytest.approx(1, abs=1e-6)


def test_defined_cases(spark):
    rows = [(None, "a b", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "...", "en", "s", 3), (4, "a b", "en", "s", 1), (4, "a b", "en", "s", 1), (5, "z y " * 40000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tokens", "2 as s")
    got = {(r.doc_id, r.tokens): r for r in lm.score_documents(docs).collect()}
    assert got[(None, 2)].log_probability == got[(4, 2)].log_probability < 0
    assert got[(1, 0)].perplexity is None and got[(2, 0)].log_probability == 0 and got[(5, 80000)].perplexity > 1
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hash_index():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 50000))
    index = lm.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert lm.HashIndex(np.zeros(0, np.int64)).find(np.array([0, 5])).tolist() == [-1, -1]


def test_rare_ngrams_count_in_a_large_corpus(spark, monkeypatch):
    """By default nothing is pruned, in a corpus where a share of 1e-6 is more than one word, and whatever the slices and shards are."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 18, raising=False)
    texts = [*corpus(5), "once only words here", "twice told tale", "twice told tale", "stop go " * 600000]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    brute = Brute(texts, 1e-12, lm.DISCOUNT)
    got = lm.score_documents(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        want = brute.score(texts[r.doc_id])
        assert r.log_probability == pytest.approx(want, abs=1e-6, rel=1e-9)


def test_failure_arcs_under_all_ngrams(spark, monkeypatch):
    """Texts that the model wasn't counted over take failure arcs, with the backoff weights of the unpruned model."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 10)
    texts = [*corpus(5), "once only words here", "ends in the", "stop go"]
    new = [*corpus(6)[:25], "novel", "once only novel here", "ends in the novel", "go stop go", "the Of w1 unheard of w1", "", None]
    frame = lambda x: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(x)], SCHEMA).repartition(3)
    brute = Brute(texts, 1e-12, lm.DISCOUNT)
    got = lm.score_documents(frame(texts), texts=frame(new)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(new)))
    for r in got:
        assert r.log_probability == pytest.approx(brute.score(new[r.doc_id]), abs=1e-6, rel=1e-9), new[r.doc_id]
