"""Large tables of questions: scored together, in few tasks, with the results of plain scans."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodeline.functions.digest import md5_heads
from lodeline.operators import index, ranks, retrieval
from lodeline.operators.staging import stored

WORDS = ["oak", "oaken", "elm", "elms", "ash", "ashes", "fir", "firs", "pine", "pinewood", "yew", "rowan", "alder", "aspen", "beech", "birch"]
#: Rare words decide; "oak" is in most texts and counts next to nothing.
WEIGHTS = [40, 20, 12, 8, 6, 5, 4, 4, 3, 3, 2, 2, 1, 1, 1, 1]


def texts(n, seed):
    random.seed(seed)
    out = [" ".join(random.choices(WORDS, WEIGHTS, k=random.randrange(1, 40))) for _ in range(n)]
    return [*out[: n - n // 5], *random.choices(out, k=n // 5)]  # copies, which tie


def asked(n, seed):
    random.seed(seed)
    pool = [*WORDS, "oak", "as", "pin", "fi", "zzz", "oak."]
    return {q: sorted(set(random.choices(pool, k=random.randrange(1, 9)))) for q in range(0, 3 * n, 3)}


def test_together_and_alone_and_by_all_passages_alike():
    top, phrases = 10, asked(300, 1)
    told = sorted({t for p in phrases.values() for t in p})
    number = {t: k for k, t in enumerate(told)}
    asks = index.Asked([[t.strip(".")] for t in told])
    questions = index.Questions(np.repeat(list(phrases), [len(p) for p in phrases.values()]), np.array([number[t] for p in phrases.values() for t in p]))
    all_texts, hits = texts(900, 2), []
    for k in range(3):
        ids = np.arange(900)[k::3]
        made = index.segment(ids, index.tokens(pa.array(all_texts[k::3])), index.tokens(pa.array([""] * len(ids))))
        hits.append(index._hits(asks, None, top)(pa.Table.from_batches([made])))
    average = sum(h["tokens"][0].as_py() for h in hits) / 900
    n = np.zeros(len(told))
    for h in hits:
        some = h["phrase"].to_numpy()
        n[some[some >= 0]] += h["n"].to_numpy()[some >= 0]
    idf = np.where(n > 0, np.maximum(np.log((900 - n + 0.5) / (n + 0.5)), 1e-6), 0)
    assert (idf == 1e-6).any() and n[number["zzz"]] == 0
    limits = np.zeros(len(told))
    want = {}
    for h in hits:
        scorer = index.Scorer(h, idf, limits, top, average)
        for q, p in phrases.items():
            want.setdefault(q, []).extend(zip(*(x.tolist() for x in scorer.best(np.array([number[t] for t in p]), whole=True))))
    want = {q: sorted((round(-s, 6), i) for i, s in x)[:top] for q, x in want.items() if x}
    by_segment = [b for h in hits for b in h.to_batches(max_chunksize=7)]
    for alone in (0, 10**6):
        before, index.ALONE = index.ALONE, alone
        got = pa.Table.from_batches(list(index._scores(questions, idf, limits, average, top)(iter(by_segment))), schema=index._SCORED).to_pylist()
        index.ALONE = before
        # A task with three segments tells no more than the best of each question.
        assert len(got) == sum(map(len, want.values()))
        found = {}
        for r in got:
            found.setdefault(r["question_id"], []).append((round(-r["total"], 6), r["chunk_id"]))
        assert {q: sorted(x) for q, x in found.items()} == want


def test_texts_without_an_index_rank_alike(spark):
    some = [t + (" c++ v1.2 Éclair" if k % 50 == 0 else "") for k, t in enumerate(texts(500, 5))]
    passages = spark.createDataFrame([(k * 7 - 99, t, "elm wood" if k % 9 == 0 else None) for k, t in enumerate(some)], "chunk_id bigint, text string, heading string").repartition(4)
    asks = spark.createDataFrame([(q, " ".join(p) + (" v1.2 eclair" if q % 2 else "")) for q, p in asked(150, 6).items()], "question_id bigint, question string")
    over = stored(index.indexed(passages), "test-index", **index.WRITING)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(retrieval.bm25(over, asks, 7))
    assert key(retrieval.bm25_of_texts(passages, asks, 7)) == want and len(want) > 900
    in_rounds = index.scores_of_texts(passages, asks, 7, per_round=60)
    assert key(ranks.ranked(in_rounds, "score", 7)) == want
    assert retrieval.bm25_of_texts(passages.limit(0), asks).count() == retrieval.bm25_of_texts(passages, asks.limit(0)).count() == 0


def test_ranks_over_many_batches(spark):
    rows = [(q, i, float(i * 7 % 11)) for q in range(40) for i in range(60)]
    df = spark.createDataFrame(rows, "question_id bigint, chunk_id bigint, score double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    got = sorted(map(tuple, ranks.ranked(df, "score", 13).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    best = sorted((float(i * 7 % 11), i) for i in range(60))[:13]
    assert got == sorted((q, i, s, k) for q in range(40) for k, (s, i) in enumerate(best, 1))


def test_hashes_and_slots_are_those_of_the_library():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start, length = rng.integers(0, 2000, 2000), np.concatenate([np.arange(130), rng.integers(0, 900, 1870)])
    want = [int.from_bytes(hashlib.md5(data[a : a + n].tobytes()).digest()[:4], "little") for a, n in zip(start.tolist(), length.tolist())]
    assert md5_heads(data, start, length).tolist() == want and len(md5_heads(data, start[:0], length[:0])) == 0
    some = ["", None, "one", "Ümläut ÉTÉ x́y ß ñ", "a b a b a", "..", "İstanbul K 3.14", "w" * 80 + " " + "v" * 30, "C++ v1.2 ＡＢ"]
    rows = retrieval._weights(pa.array(some))
    for text, row in zip(some, rows):
        bare = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not "̀" <= c <= "ͯ")
        words = [w for w in re.split("[^a-z0-9]+", bare) if w]
        slots = np.zeros(256, np.int64)
        for gram in [*words, *(" ".join(p) for p in zip(words, words[1:])), *words[-1:]]:
            h = hashlib.md5(gram.encode()).hexdigest()
            slots[int(h[2:4], 16)] += 1 if int(h[5], 16) % 2 == 0 else -1
        assert row.tolist() == slots.tolist(), text
    assert retrieval._weights(pa.array([], pa.string())).shape == (0, 256)


def test_nearest_in_single_precision_first_is_exact(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 24))
    vectors = (vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]).astype(np.float32)
    vectors[1::3] = vectors[::3] + (1e-7 * rng.normal(size=(1000, 24))).astype(np.float32)  # hardly apart
    vectors[2::30] = vectors[2]  # copies
    vectors[50] = 0
    for scale in (1.0, 300.0):
        some = (vectors * scale).astype(np.float32)
        apart = np.round(np.sqrt(np.maximum(((some[:100, None, :].astype(np.float64) - some[None].astype(np.float64)) ** 2).sum(axis=2), 0)), 6)
        near = retrieval.Nearest(np.arange(100), some[:100], 12)
        for a, b in ((0, 5), (5, 1300), (1300, 3000)):
            near.see(np.arange(a, b), some[a:b])
        got = pa.Table.from_batches(list(near.rows()))
        assert got.num_rows == 1200  # as few as there can be, whatever is seen
        at = got["chunk_id"].to_numpy().reshape(100, 12)
        for q in range(100):
            want = np.lexsort((np.arange(3000), apart[q]))[:12]
            assert np.allclose(apart[q][at[q]], apart[q][want], atol=2e-6 * scale)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id bigint, embedding array<float>").repartition(3)
    asks = df.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "question_id")
    key = lambda d: sorted(map(tuple, d.select("question_id", "chunk_id", "rank", F.round("distance", 5)).collect()))
    assert key(retrieval.nearest(df, asks, 9)) == key(retrieval.nearest(df, asks, 9, few=25))
