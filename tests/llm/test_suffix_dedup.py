import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeline.llm import suffix_dedup
from lodeline.llm.anchors import anchors
from lodeline.llm.sorted_runs import LoserTree, common_prefixes, decoded, front_coded, merged

from .cases import DOCUMENTS, ODD, clashing, rows


def brute(texts, window):
    seen = {}
    for d, t in enumerate(texts):
        for s in range(len(t) - window + 1):
            seen.setdefault(t[s : s + window], []).append((d, s))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, s in places:
                gone[d][s : s + window] = True
    out = []
    for t, g in zip(texts, gone):
        left = np.frombuffer(t, np.uint8)[~g].tobytes()
        out.append((len(t), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts, window, **how):
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(clashing(rows(spark, texts)), window, **how).collect()}
    assert [got[i] for i in range(len(texts))] == brute(raw, window)


def tangled(seed, n=60):
    """Texts whose repeats start, end and overlap everywhere."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdé ") for _ in range(random.randint(1, 9)))
    passages = ["".join(word() for _ in range(random.randint(5, 40))) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(random.randint(0, 6)):
            p = random.choice(passages)
            a = random.randint(0, len(p) // 2)
            t += random.choice([p, p[a:], p[:-a or None], "".join(word() for _ in range(20))])
        texts.append(t)
    return texts + ["x" * 150, "xy" * 100, "", None, texts[0], texts[1], *ODD]


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, tangled(seed), 60)


def test_frequent_grams_are_merged_too(spark):
    check(spark, tangled(3), 60, hot=1)
    check(spark, tangled(5, 25), 200, hot=2)


def test_windows_out_of_range(spark):
    for window in (31, 256):
        with pytest.raises(ValueError):
            suffix_dedup.removed(rows(spark, ["x"]), window)


def test_long_text_and_repeated_rows(spark):
    random.seed(9)
    long = "".join(random.choice("abcdefgh ") for _ in range(600_000))
    texts = [long, "short " + long[300_000:300_400], long[:100]]
    check(spark, texts, 200)
    same = spark.createDataFrame([(None, long[:900]), (None, long[:900]), (4, None), (4, None)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(same).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (900, 900, 1), (900, 900, 1)]


def test_documents(spark):
    texts = pq.read_table(DOCUMENTS)["text"].to_pylist()[:120]
    check(spark, texts, 200)


def test_cut_texts_keep_columns(spark):
    same = "The same long passage, word for word, in every one of them. " * 5
    df = rows(spark, [f"{same}é one", f"two {same}", None, ""])
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(df).collect()}
    assert got[0].text.endswith("é one") and len(got[0].text) < 20 and got[0].n_chars == len(got[0].text)
    assert got[2].text == "" and sorted(got) == [0, 1, 2, 3]
    assert suffix_dedup.deduplicated(rows(spark, [])).count() == 0
    assert suffix_dedup.removed(rows(spark, [])).count() == 0


def test_equal_windows_have_equal_anchors():
    random.seed(4)
    t = bytes(random.choice(b"ab") for _ in range(3000)) * 2
    starts = np.array([0, 1000, 3500, 6000])
    at, hashes, lo, hi = anchors(np.frombuffer(t, np.uint8), starts, 100)
    chosen = {}
    covered = 0
    for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist()):
        for s in range(x, y + 1):
            covered += 1
            assert chosen.setdefault(t[s : s + 100], a - s) == a - s
    assert covered == sum(n - 99 for n in np.diff(starts))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=7))
def test_merge_of_front_coded_runs(lists):
    runs = []
    for x in lists:
        m = np.frombuffer(b"".join(sorted(x)), np.uint8).reshape(-1, 6)
        shared, rests = front_coded(m)
        assert (decoded(shared, rests, 6) == m).all()
        runs.append((m, shared))
    order, agree = merged(runs)
    whole = np.concatenate([m for m, _ in runs])[order] if len(order) else np.zeros((0, 6), np.uint8)
    assert [r.tobytes() for r in whole] == sorted(y for x in lists for y in x)
    assert (agree[1:] == common_prefixes(whole)[1:]).all()


def test_merge_does_not_compare_known_prefixes():
    lists = [sorted(b"%050d" % i for i in range(k, 400, 4)) for k in range(4)]
    runs = [(x, common_prefixes(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 50)).tolist()) for x in lists]
    tree = LoserTree(runs)
    assert len(list(tree)) == 400
    assert tree.compared < 400 * 8
