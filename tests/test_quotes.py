"""Quotes met by their rare words, against looking for all in all."""

import random

from pyspark.sql import functions as F

from lodeline.functions import text as T
from lodeline.operators import quotes


def test_no_pair_is_lost(spark):
    random.seed(4)
    words = ["hive", "honeycomb", "comb", "queen", "an", "of", "wax", "wax", "smoker", "lid", "frames", "nectar", "brood", "a", "swarm"]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(1, 40))) for _ in range(300)] + ["", None, "to be or so it is", "Un ÉTÉ de miel, été"]
    asked = []
    for _ in range(120):
        w = random.choice(texts[:300]).split()
        w = [x if random.random() > 0.12 else random.choice(["zzz", "lid", "of"]) for x in w[: random.randrange(2, 24)]]
        asked.append(" ".join(w))
    asked += ["", None, "short", "or so it is", "be or so it", "of of of of of", "  Honeycomb   SMOKER ", "wax wax wax wax wax wax swarmx", "ete de miel,"]
    q = spark.createDataFrame(list(enumerate(asked)), "item_id bigint, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in quotes.appearing(q, t).collect())
    pairs = q.crossJoin(t).filter(T.quote_appears(F.col("quote"), F.col("text")))
    want = sorted((r.item_id, r.doc_id, T_normal(r.quote) in T_normal(r.text)) for r in pairs.collect())
    assert got == want and len({w for *_, w in got}) == 2 and len(got) > 300
    assert quotes.appearing(q.limit(0), t).count() == 0 and quotes.appearing(q, t.limit(0)).count() == 0


def T_normal(x):
    return " ".join((x or "").lower().replace("é", "e").split())


def test_quotes_meet_texts_by_keys_only(spark):
    q = spark.createDataFrame([(1, "honey is ripe when sealed")], "item_id bigint, quote string")
    t = spark.createDataFrame([(1, "the honey is ripe when it is sealed")], "doc_id bigint, text string")
    plan = quotes.appearing(q, t)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
