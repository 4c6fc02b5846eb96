"""Spelling variants, secrets and resampling against brute force."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodeline.llm import crc, minhash, resampling, secret_scan, shingles, spelling
from lodeline.llm.common import stored

from .cases import DOCUMENTS, ODD, clashing, rows
from .test_corpus import brute_components


def texts():
    return pq.read_table(DOCUMENTS)["text"].to_pylist()


def lowered(t):
    return t.encode().lower().decode()


# ---- spelling ---------------------------------------------------------------

def brute_words(numbered):
    n = Counter()
    for i, t in numbered:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    sized = defaultdict(list)
    for w in n:
        sized[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in sized[len(w) + k] if one_apart(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v.encode())) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_spelling_variants(spark):
    random.seed(5)
    made = [" ".join("".join(random.choice("abé") for _ in range(random.randrange(4, 8))) for _ in range(300)) for _ in range(12)]
    chain = " ".join(["kettle"] * 3 + ["kettles"] * 6 + ["nettles"] * 12 + ["nettlex"] * 24 + ["aaaaab"] * 4 + ["aaaaaab"] * 9 + ["aaaab"] * 30)
    many = [None, "", *ODD, *made, chain, chain, "KETTLE Kettle kETTLE " * 2, "x" * 40_000 + " " + "x" * 40_000, *texts()[:60]]
    docs = clashing(rows(spark, many))
    got = [tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(brute_words(enumerate(many)))
    assert len(got) == len(want) and set(got) == want
    assert max(r[4] for r in got) > 5 and len({r[2] for r in got}) < len(got)
    assert spelling.variants(rows(spark, [])).count() == 0
    null_ids = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert {r.word: r.n for r in spelling.words(null_ids).collect()} == brute_words((None, t) for t in many)


def test_a_range_holds_no_more_than_the_alphabet(spark):
    letters = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
    n = spark.createDataFrame([(f"abc{x}def", i + 3) for i, x in enumerate(letters)] + [("abcdef", 500)], "word string, n bigint")
    sizes = spelling.rotations(n).groupBy("range").count().agg(F.max("count")).first()[0]
    assert sizes == len(letters) + 1
    near = {r.word: (r.n_near, r.best.word) for r in spelling.neighbours(n).collect()}
    assert near["abcdef"] == (len(letters), f"abc{letters[-1]}def") and near["abcadef"] == (len(letters), "abcdef")


def test_chains_of_forms_are_followed(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("v", "w30")], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w37"} and spelling.roots(forms.limit(0)).count() == 0


# ---- secrets ----------------------------------------------------------------

KEY = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_base(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in KEY.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def brute_spans(t, table):
    t, base, a = t or "", brute_base(t), secret_scan.ALPHABET
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", t):
        score = sum(table[(0 if p is None else a.index(p) + 1) * len(a) + a.index(c)] for p, c in zip([None, *m[0]], m[0]))
        if score >= secret_scan.NEEDED and not any(s < m.end() and m.start() < e for s, _, e in base):
            yield m.start(), 3, m.end()


def brute_table(docs):
    """From (doc_id, text)."""
    strings = [x for _, t in docs for s, k, e in brute_base(t) for x in [re.sub("[^A-Za-z0-9+/_=-]+", "", KEY.search(t, s)[1] if k == 0 else t[s:e])]]
    some = sorted({(d[0], d[1] or "") for d in docs}, key=lambda d: hashlib.sha256(f"{'' if d[0] is None else d[0]}:{d[1]}".encode()).hexdigest())[: secret_scan.SAMPLE]
    rest = [re.sub("[0-9a-f]{16,}", " ", re.sub("AKIA[A-Z0-9]{14,}", " ", KEY.sub(" ", t or ""))) for _, t in some]
    names = [x for t in rest for x in re.findall("[A-Za-z0-9+/_=-]{4,}", t)]
    x, y = (Counter(p for s in many for p in zip("^" + s, s)) for many in (strings, names))
    a, out = secret_scan.ALPHABET, []
    for p in "^" + a:
        n, m = sum(x[p, c] for c in a), sum(y[p, c] for c in a)
        out += [math.floor(1000 * (math.log(0.5 * (x[p, c] / n if n else 1 / len(a)) + 0.5 / len(a)) - math.log((y[p, c] + 0.5) / (m + 0.5 * len(a)))) + 0.5) for c in a]
    return out


def secret(n, letters=string.ascii_letters + string.digits + "+/"):
    return "".join(random.choice(letters) for _ in range(n))


def test_secret_scan(spark):
    random.seed(7)
    hard = [
        f'token = "{secret(40)}" and TOKEN:{secret(20)} and secret= short, api_key="{secret(30, "0123456789abcdef")}"', f"AKIA{secret(16, string.ascii_uppercase)} é AKIAKIAKIA AKIA1234",
        f"héllo 😀 {secret(32)} wörld {secret(24)}", "password: passwd: abcdefghijklmnop", "token=secret=abcdefghijkl", "xapi_keys = 1234567890123", "deadbeef" * 4 + "Z", "a" * 20, "the-quick-brown-fox-jumps-over",
        " ".join(secret(32, "0123456789abcdef") for _ in range(700)), f"{secret(40)} " * 300, "token=" * 50, "=" * 30, "\n" + secret(20) + "\n",
    ]
    many = [None, "", *ODD, *hard, hard[0], *texts()]
    docs = clashing(rows(spark, many)).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    numbered = [(None if i == 3 else i, t) for i, t in enumerate(many)]
    table = secret_scan.ratios(*secret_scan.samples(docs))
    assert table == brute_table(numbered)
    got = {r.doc_id: r for r in secret_scan.scanned(docs, table).collect()}
    assert len(got) == len(many)
    for i, t in numbered:
        base, more = brute_base(t), list(brute_spans(t, table))
        r = got[i]
        assert [tuple(x) for x in r.base_spans] == base and [tuple(x) for x in r.spans] == sorted(base + more), i
        assert [r.n_assign, r.n_access, r.n_hex, r.n_random] == [*(sum(x[1] == k for x in base) for k in range(3)), len(more)]
    text = secret_scan.scanned(docs, table).select("doc_id", secret_scan.written(F.col("spans")).alias("w")).filter(f"doc_id = {many.index(hard[1])}").first().w
    assert text.startswith("access:0:20")
    assert secret_scan.scanned(rows(spark, [])).count() == 0


def test_chains_tell_held_out_secrets_from_identifiers(spark):
    """Made secrets of kinds the patterns do not know, and long words that no sample has."""
    random.seed(11)
    known = texts()
    table = secret_scan.ratios(*secret_scan.samples(rows(spark, known)))
    words = [w for t in pq.read_table(DOCUMENTS.replace("sf0.001", "sf0.01"))["text"].to_pylist()[400:] for w in re.findall("[A-Za-z]{7,}", t)]
    plain = [f"{a}{random.choice(['_', '-', ''])}{b}" for a, b in zip(words[::2], words[1::2]) if len(a + b) >= 16][:2000]
    made = [secret(random.randrange(20, 44)) + "Q" for _ in range(1000)]
    a = secret_scan.ALPHABET
    score = lambda s: sum(table[(0 if p is None else a.index(p) + 1) * len(a) + a.index(c)] for p, c in zip([None, *s], s))
    assert sum(score(s) >= secret_scan.NEEDED for s in made) >= 0.97 * len(made)
    assert sum(score(s) >= secret_scan.NEEDED for s in plain) <= 0.01 * len(plain)


def test_the_sample_is_of_different_documents(spark):
    docs = rows(spark, [f"text {i}" for i in range(400)] + [None, ""]).union(rows(spark, ["copy"]).crossJoin(spark.range(5000)).drop("id"))
    every = {(r.doc_id, r.text or "") for r in docs.collect()}
    least = sorted(every, key=lambda d: hashlib.sha256(f"{'' if d[0] is None else d[0]}:{d[1]}".encode()).hexdigest())
    for n in (1, 7, 300, 9999):
        assert sorted(r.text for r in secret_scan.sampled(docs, n).collect()) == sorted(t for _, t in least[:n])


def test_running_values(spark):
    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        a = [random.randrange(-50, 50) for _ in range(n)]
        df = spark.createDataFrame([(a,)], "a array<int>").select(secret_scan.running(F.col("a"), lambda x, y: x + y, F.lit(0)).alias("s"), secret_scan.running(F.col("a"), lambda x, y: F.greatest(x, y), F.lit(-99)).alias("m"))
        r = df.first()
        assert r.s == np.cumsum(a).astype(int).tolist() and r.m == np.maximum.accumulate(np.array(a, int)).tolist()


# ---- resampling -------------------------------------------------------------

def brute_counts(t):
    w, n = re.findall(resampling.WORD, lowered(t or "")), Counter()
    for k in (1, 2, 3):
        n.update(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w) - k + 1))
    return len(w), n


def brute_resampled(docs, target):
    """From (doc_id, text) and texts."""
    found = [(i, t, *brute_counts(t)) for i, t in docs]
    s, t = sum((f[3] for f in found), Counter()), sum((brute_counts(x)[1] for x in target), Counter())
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for i, _, words, n in found:
        weight, score = sum(gain(b) * k for b, k in n.items()), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, words, sum(n.values()), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def test_resampling(spark):
    many = [None, "", *ODD, "one " * 19, "one " * 20, "same words here " * 30, "same words here " * 30, *texts()]
    target = [None, "", *texts()[5:9], "One two THREE"]
    docs = clashing(rows(spark, many)).withColumn("doc_id", F.when(F.col("doc_id") != 40, F.col("doc_id")))
    got = resampling.resampled(docs, clashing(rows(spark, target))).collect()
    want = brute_resampled([(None if i == 40 else i, t) for i, t in enumerate(many)], target)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 1 + 5 * sum(len(re.findall(resampling.WORD, lowered(t or ""))) >= 20 for i, t in enumerate(many) if i != 40) // 100))
    assert resampling.resampled(rows(spark, []), rows(spark, target)).count() == 0
    assert {r.rank for r in resampling.resampled(rows(spark, ["a b"] * 5), rows(spark, [])).collect()} == {None}


def test_ranks_go_on_across_ranges_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANKED", 20)
    docs = rows(spark, [f"{'word ' * 25}{i % 7}" for i in range(300)]).withColumn("doc_id", F.col("doc_id") % 50)
    got = resampling.resampled(docs, docs.limit(3), percent=60).collect()
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, 181)) and [(-r.score, r.doc_id) for r in drawn] == sorted((-r.score, r.doc_id) for r in drawn)
    assert min(r.score for r in drawn) >= max(r.score for r in got if not r.rank)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_long_texts_are_counted_whole(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling.pieces, "__defaults__", (piece,))
    many = [*ODD, "y" * 90 + " Z " + "é" * 50 + " end", *texts()]
    memory, got = resampling.Words(), [Counter() for _ in many]
    for bucket, document, _ in resampling.counted(pa.array(many), memory):
        for b, d in zip(bucket.tolist(), document.tolist()):
            got[d][b] += 1
    assert got == [brute_counts(t)[1] for t in many]


def test_crc():
    parts = [bytes(random.randrange(256) for _ in range(random.choice([0, 1, 3, 64, 65, 200]))) for _ in range(300)]
    buf, size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    own = crc.of_spans(buf, np.cumsum(size) - size, size)
    assert own.tolist() == [zlib.crc32(p) for p in parts]
    before = np.array([zlib.crc32(b"ab" + p) for p in parts], np.uint32)
    assert crc.joined(before, own, size, lambda i: parts[i]).tolist() == [zlib.crc32(b"ab" + p + p) for p in parts]


# ---- near duplicates of few words -------------------------------------------

def test_short_texts_that_share_a_phrase_meet_nowhere(spark, monkeypatch):
    sizes = {}

    def counted(df, label, **how):
        out = stored(df, label, **how)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    for n in (500, 2000):
        out = minhash.grouped(rows(spark, [f"see also page n{i}" for i in range(n)] + [f"a b c d e f g n{i}" for i in range(n)]), words=2)
        assert out.filter("kept").count() == 2 * n
        assert sizes["candidates"] == sizes["members"] == 0


@pytest.mark.parametrize("words", [2, 5])
def test_sets_of_few_shingles(spark, words):
    random.seed(words)
    many = [" ".join(random.choice("abcdef") for _ in range(random.randrange(1, 14))) for _ in range(120)]
    for _ in range(160):
        w = random.choice(many).split()
        k = random.randrange(len(w) + 1)
        many.append(" ".join(random.choice([w[1:], w[:-1], [*w, random.choice("abcx")], w[:k] + ["x"] + w[k:]])))
    want, sizes = brute_components(many, words)
    got = {r.doc_id: r for r in minhash.grouped(rows(spark, many), words=words).collect()}
    assert [got[i].component_id for i in range(len(many))] == want and [got[i].n_shingles for i in range(len(many))] == sizes
    assert len(set(want)) < len(set(many)) - 20


def test_full_sets_are_read_of_possible_links_only(spark, monkeypatch):
    random.seed(5)
    sizes = {}

    def counted(df, label, **how):
        out = stored(df, label, **how)
        sizes[label] = out.count()
        return out

    def edited(words, n):
        at = set(random.sample(range(len(words)), n))
        return [f"e{random.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]

    monkeypatch.setattr(minhash, "stored", counted)
    many = []
    for k in range(150):  # of about 0.6, which share buckets and are no links
        w = [f"w{k}x{i}" for i in range(60 + 10 * k)]
        many += [" ".join(w), " ".join(edited(w, len(w) // 8))]
    for k in range(20):  # links
        w = [f"y{k}x{i}" for i in range(60 + 40 * k)]
        many += [" ".join(w), " ".join(edited(w, len(w) // 40))]
    want, _ = brute_components(many, 2)
    got = {r.doc_id: r.component_id for r in minhash.grouped(rows(spark, many), words=2).collect()}
    assert [got[i] for i in range(len(many))] == want and len(set(want)) == len(many) - 20
    assert sizes["candidates"] > 100  # they do meet
    assert sizes["star-ids"] + sizes["small-ids"] <= 60
    assert sizes["buckets"] <= 2 * 32 * 170 and sizes["placed"] == len(many)


@pytest.mark.parametrize("n", [1, 3, 31, 32, 33, 100, 250, 520, 1030, 2050, 5000])
def test_parities_rule_out_no_link(n):
    rng = np.random.default_rng(n)
    for more, fewer in ((0, 0), (n // 4, 0), (n // 9, n // 9), (n // 9 + 1, n // 9), (n, n // 2), (9 * n, n)):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        b = np.sort(np.concatenate((a[: n - fewer], rng.integers(0, 2**64, more, np.uint64))))
        if not len(b):
            continue
        x, y = shingles.parities(a), shingles.parities(b)
        size = min(len(x), len(y))
        assert shingles.folded(shingles.folded(x, size), 8) == shingles.folded(x, 8)
        apart = (int.from_bytes(shingles.folded(x, size)) ^ int.from_bytes(shingles.folded(y, size))).bit_count()
        assert apart <= len(np.setxor1d(a, b))
        possible = shingles.differ_at_most(apart, len(a) + len(b), 80)
        assert possible or not shingles.jaccard_at_least(a, b, 80)
        assert shingles.differ_at_most(len(np.setxor1d(a, b)), len(a) + len(b), 80) == shingles.jaccard_at_least(a, b, 80)
    other = shingles.parities(rng.integers(0, 2**64, n, np.uint64))
    apart = (int.from_bytes(other) ^ int.from_bytes(shingles.parities(a))).bit_count()
    assert n < 31 or n > shingles.CELLS or not shingles.differ_at_most(apart, 2 * n, 80)
