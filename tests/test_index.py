"""The inverted index against plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import index, retrieval
from lodeline.operators.staging import stored

ODD = ["", None, " ", "C++ and c, v1.2 of three-way (three way) v1 2", "Ümläut ÉTÉ naïve ＡＢ ñ ß Σίσυφος x́y", "a b c", "don't 3.14 10% ½", "İstanbul Kelvin K", "word " * 500, "-- ?? !!"]


def written(passages):
    return stored(index.indexed(passages), "test-index", **index.WRITING)


def made(spark, texts, headings=None):
    rows = [((i * 7919 % 1009) - 300, t, (headings or {}).get(i, "")) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "chunk_id bigint, text string, heading string").repartition(3)


def test_tokens_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    assert index.tokens(pa.array(ODD)).to_pylist() == [r.t for r in df.select(T.tokens(F.col("t")).alias("t")).collect()]


def test_gaps_of_any_ids():
    ids = np.array([-(2**63), 5, 2**63 - 1, -4, 9, 9], np.int64)
    starts = np.array([0, 3, 4])
    assert index.ids_of(index.gaps(ids, starts), starts).tolist() == ids.tolist() and len(index.ids_of(ids[:0], starts[:0])) == 0


def brute(rows, questions):
    """question -> {chunk: score}, by scanning all tokens for all phrases."""
    word = lambda t: [x for x in re.split(r"[\W_]+", "".join(c for c in __import__("unicodedata").normalize("NFD", (t or "")) if not "̀" <= c <= "ͯ").lower()) if x]
    docs = {i: (word(t), word(h)) for i, t, h in rows}
    total, n = sum(len(a) + len(b) for a, b in docs.values()), len(docs)

    def hits(tokens, words):
        return sum(all((w.startswith(t) if k == len(tokens) - 1 else w == t) for k, (t, w) in enumerate(zip(tokens, words[i:]))) for i in range(len(words) - len(tokens) + 1))

    out = {}
    for q, phrases in questions.items():
        got = {}
        for tokens in ([x for x in re.split("[^a-z0-9]+", p) if x] for p in phrases):
            f = {i: hits(tokens, a) + 0.6 * hits(tokens, b) for i, (a, b) in docs.items()} if tokens else {}
            f = {i: x for i, x in f.items() if x}
            idf = math.log((n - len(f) + 0.5) / (len(f) + 0.5))
            for i, x in f.items():
                d = sum(map(len, docs[i]))
                got[i] = got.get(i, 0) + (idf if idf > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * d / (total / n)))
        out[q] = got
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(3)
    words = ["hive", "hives", "honey", "honeycomb", "queen", "three", "way", "c", "v1", "2", "wax", "waxy", "bee", "beet", "frame"]
    texts = [*ODD, *(" ".join(random.choice(words) for _ in range(random.randrange(1, 60))) for _ in range(400))]
    rows, df = made(spark, texts, {i: random.choice(["The Queen", "three-way hive", ""]) for i in range(50)})
    return rows, written(df)


QUESTIONS = ["three-way frames", "c++ v1.2 beehive", "honey wax queen", "hiv wax", "what is the", "", None, "zzz", "three-way hive waxy", "v1.2"]


def test_ranking_is_that_of_a_full_scan(spark, corpus, monkeypatch):
    rows, stored_index = corpus
    monkeypatch.setattr(index, "RANGE", 8)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id bigint, question string")
    phrases = {r.question_id: [x.phrase for x in r.p] for r in index.phrases(asked).groupBy("question_id").agg(F.collect_list(F.struct("phrase")).alias("p")).collect()}
    want = set()
    for q, got in brute(rows, phrases).items():
        ranked = sorted((round(-s, 6), i) for i, s in got.items())[:10]
        want |= {(q, i, s, k) for k, (s, i) in enumerate(ranked, 1)}
    found = {(r.question_id, r.chunk_id, r.score, r["rank"]) for r in retrieval.bm25(stored_index, asked, 10).collect()}
    near = lambda rows_: sorted((q, k, i, round(s, 5)) for q, i, s, k in rows_)
    assert near(found) == near(want) and len({q for q, *_ in want}) == 6
    in_rounds = retrieval.best(index.scores(stored_index, asked, 10, per_round=2), "question_id", F.col("score").asc(), 10)
    assert {(r.question_id, r.chunk_id, r.score, r["rank"]) for r in in_rounds.collect()} == found
    assert retrieval.bm25(stored_index.limit(0), asked).count() == 0 and retrieval.bm25(stored_index, asked.limit(0)).count() == 0


def test_ranges_are_skipped_and_the_best_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(index, "RANGE", 16)
    random.seed(9)
    # Common words everywhere; the rare one in one region of ids.
    texts = [" ".join(random.choice(["oak", "elm", "ash"]) for _ in range(random.randrange(5, 90))) + (" willow" * (i % 5) if 700 < i < 760 else "") for i in range(2000)]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "chunk_id bigint, text string, heading string").coalesce(1)
    asked = index.Asked([["oak"], ["elm"], ["willow"]])
    table = index.indexed(df).toArrow()
    hits = index._hits(asked, 40.0, 10)(table.filter(asked.wants(table["term"].combine_chunks())))
    idf = np.array([0.01, 0.01, 3.5])
    limits = np.zeros(3)
    for k, kth in zip(hits["phrase"].to_pylist(), hits["kth"].to_pylist()):
        limits[k] = max(limits[k], kth)
    scorer = index.Scorer(hits, idf, limits, 10)
    best = lambda x: sorted((round(-s, 6), int(i)) for i, s in zip(*x))[:10]
    some = best(scorer.best(np.array([0, 1, 2])))
    assert scorer.skipped > 0.8 * scorer.seen
    assert some == best(scorer.best(np.array([0, 1, 2]), whole=True)) and len(some) == 10


def test_only_asked_terms_leave_the_files(spark, corpus):
    _, stored_index = corpus
    asked = index.Asked([["three", "way"], ["wax"]])
    plan = asked.pushed(stored_index)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,wax)" in plan
    left = {t for b in stored_index.toArrow().to_batches() for t in b.filter(asked.wants(b.column(0))).column(0).to_pylist()}
    assert left == {"", "three", "way", "wax", "waxy"}


def test_segments_are_bounded_and_ordered(spark, corpus, monkeypatch):
    _, stored_index = corpus
    table = stored_index.toArrow()
    assert max(pc.list_value_length(table["ids"]).to_pylist()) <= index.BLOCK and len(set(table["segment"].to_pylist())) == 3
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["a b c d"] * 1000), pa.array([""] * 1000)], names=["chunk_id", "text", "heading"])
    monkeypatch.setattr(index, "SEGMENT", 2000)
    parts = list(index._segments(iter([batch])))
    assert len(parts) == 2 and all(p.column(0).to_pylist() == sorted(p.column(0).to_pylist()) for p in parts)
    again = index.Segment(pa.Table.from_batches(parts[:1]))
    assert again.ids.tolist() == list(range(500)) and again.phrase(["b", "c", "d"])[0].tolist() == list(range(500)) and len(again.phrase(["b", "d"])[0]) == 0
