import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from lodeline.llm import maxent_lm as lm

from .cases import DOCUMENTS, ODD, clashing, rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + ["\n"]


def brute(texts):
    out = zlib.crc32
    c = Counter(w for i, t in enumerate(texts) if out(str(i).encode()) % 7 != 2 for w in split(t))
    n, v = sum(c.values()), len(c)
    return c, {i: (out(str(i).encode()) % 7 == 2, len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in enumerate(texts)}


def slow_score(text, corpus, weights, counts):
    """log10 probability, token by token and choice by choice, in plain Python."""
    index, total = {w: i for i, w in enumerate(corpus.named)}, 0.0
    second = before = lm.START
    for w in split(text):
        s = index.get(w, lm.NAMED + zlib.crc32(w.encode()) % (lm.CONTEXTS - lm.NAMED))
        cls = min(s // 4096, 15)
        path = [(0, cls)] + ([(1 + cls, s // 256 % 16), (17 + s // 256, s // 16 % 16), (273 + s // 16, s % 16)] if cls < 15 else [])
        features = lm.hashed_features(np.array([second]), np.array([before]))
        for node, made in path:
            used = features if node == 0 else features[:2]
            z = [float(corpus.bias[node, k]) + sum(float(weights[int(lm.weight_rows(f, np.array([node]))[0]), k]) for f in used) for k in range(16)]
            total += z[made] - math.log(sum(map(math.exp, z)))
        if cls == 15:
            total += math.log((counts[w] + 1) / corpus.rare)
        second, before = before, s
    return total / math.log(10)


def test_base_counts_and_held_out_gain(spark):
    texts = pq.read_table(DOCUMENTS)["text"].to_pylist() + [None, *ODD, "twin Twin", "twin Twin"]
    got = {r.doc_id: r for r in lm.scored(clashing(rows(spark, texts)), block_tokens=3000).collect()}
    base = better = 0.0
    for i, (held, n, known, total, score) in brute(texts)[1].items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - score) < 1e-6 * max(1, abs(score))
        if held:
            base, better = base + score, better + r.score
    assert len(got) == len(texts) and better > base
    assert lm.scored(rows(spark, [])).count() == 0


def test_scores_equal_plain_recomputation(spark):
    texts = ["the cat sat on the mat the end " * 3, "the cat ate the rat", None, "", "quite Other words are here, the cat too", "the " * 40, "zig zag"]
    docs = rows(spark, texts)
    corpus = lm.Corpus(docs, block_tokens=20)
    weights = lm.trained(corpus.blocks, corpus.bias, corpus.n)
    assert np.abs(weights).max() > 0
    counts, got = brute(texts)[0], {r.doc_id: r.score for r in lm.scored(docs, block_tokens=20).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - slow_score(t, corpus, weights, counts)) < 1e-3, t


def test_rare_words_share_a_class(spark):
    words = [f"w{i}x" for i in range(lm.NAMED + 500)]
    texts = [" ".join(words), " ".join(words[: lm.NAMED - 100]), "w7x w31999x never seen"]
    corpus = lm.Corpus(rows(spark, texts))
    weights = lm.trained(corpus.blocks, corpus.bias, corpus.n)
    assert len(corpus.named) == lm.NAMED
    counts, got = brute(texts)[0], {r.doc_id: r for r in lm.scored(rows(spark, texts)).collect()}
    assert corpus.rare == sum(c for w, c in counts.items() if w not in corpus.named) + len(counts) - lm.NAMED + 1
    assert abs(got[2].score - slow_score(texts[2], corpus, weights, counts)) < 1e-3


def test_odd_tables(spark):
    same = spark.createDataFrame([(1, "b a"), (1, "b a"), (None, "b a"), (None, None), (7, "x " * 30_000)], "doc_id bigint, text string")
    got = lm.scored(same).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 3), (False, 3), (False, 30_001), (True, 1), (True, 3)]
    twins = [r.score for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]
    held = [i for i in range(60) if lm.held_out(i)][:3]
    alone = lm.scored(spark.createDataFrame([(i, "only held out") for i in held], "doc_id bigint, text string")).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)} and all(r.score < 0 for r in alone)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(lm.ROWS, lm.BRANCH)).astype(np.float32)
    bias = lm.biases(rng.integers(0, 9, lm.NAMED + 1).astype(float))
    symbols = np.arange(lm.NAMED + 1)  # the last stands for all rare words
    for second, before in ((3, lm.START), (lm.START, lm.START), (70, 40_000)):
        logs = lm.log_probabilities(weights, bias, symbols, np.full(len(symbols), second), np.full(len(symbols), before))
        assert abs((10**logs).sum() - 1) < 1e-4


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(lm.ROWS, lm.BRANCH)).astype(np.float32)
    bias = lm.biases(np.ones(lm.NAMED + 1))
    second, before, s = rng.integers(0, 3, 60), rng.integers(0, 3, 60), rng.integers(0, 40, 60) * 900
    likelihood = lambda: float(lm.log_probabilities(weights, bias, s, second, before).sum() * np.log(10))
    found = {}
    for touched, times, total in lm.gradients(weights, bias, s, second, before):
        assert len(set(touched.tolist())) == len(touched) and times.min() > 0
        for r, g in zip(touched.tolist(), total):
            found[r] = found.get(r, 0) + g
    for r in list(found)[::7]:
        k = int(np.abs(found[r]).argmax())
        old = weights[r, k]
        weights[r, k] = old + 0.01
        up = likelihood()
        weights[r, k] = old - 0.01
        assert abs((up - likelihood()) / 0.02 - found[r][k]) < 0.03 * abs(found[r][k]) + 0.05
        weights[r, k] = old
