import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodeline.llm import fingerprints, language_id, minhash, packing, quality_rules, suffix_dedup
from lodeline.llm.components import components
from lodeline.llm.tokens import BYTE_BPE, library, vocabulary_path

from .cases import DOCUMENTS, ODD, clashing, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    return pq.read_table(DOCUMENTS)["text"].to_pylist()


# ---- quality rules ----------------------------------------------------------

def brute_quality(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeat = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


def brute_line_fails(line):
    w = WORDS.findall(line)
    bare = line.strip(" \t\n\x0b\x0c\r")
    marked = max(sum(any(c in "#*$%&|<>" for c in x) for x in w), len(re.findall(r"[!?]{2,}", line)))
    punctuation = 100 * marked > 30 * len(w) or len(w) >= 4 and not re.search(r"""[.!?:;"')\]…”»。]\Z""", bare)
    navigation = len(re.findall("[|»›•·>]", line)) >= 3 or bool(re.search(quality_rules.NAVIGATION.replace(r"\z", r"\Z"), bare))
    return punctuation or navigation or bool(re.search(quality_rules.BOILERPLATE, line))


def brute_clean(text):
    return "\n".join(x for x in (text or "").split("\n") if not brute_line_fails(x))


def brute_kept(text):
    count = lambda t: sum(map(len, WORDS.findall(t)))
    n = count(text or "")
    return not brute_quality(text)[5] and 100 * (n - count(brute_clean(text))) <= 50 * n


def test_quality_rules(spark):
    nav = "Home | About | Contact | Shop\n" + "A sentence of words that ends well. " * 20 + "\nAll rights reserved."
    good = "A line of many words that ends as it should. " * 9
    far = f"{good}\n{' ' * 80}Home\n{good} You should click here for more of it. {good}\n\tSkip to content.\x0b\n{good}" + "COPYRIGHT of the text, 2020.\n" + good * 300
    many = [None, "", " \n\n ", "a b c " * 40, nav, nav, far, "x\n" * 500, *ODD, *texts()]
    got = {r.doc_id: r for r in quality_rules.judged(clashing(rows(spark, many))).collect()}
    for i, t in enumerate(many):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t), i
        assert r.clean_text == brute_clean(t) and r.kept == brute_kept(t), i
    assert len(got) == len(many) and quality_rules.judged(rows(spark, [])).count() == 0
    kept = {r.doc_id: r for r in quality_rules.cleaned(rows(spark, many)).collect()}
    assert set(kept) == {i for i, t in enumerate(many) if brute_kept(t)}
    assert all(r.text == brute_clean(many[i]) and r.n_chars == len(r.text) and r.source == "s" for i, r in kept.items())


# ---- near duplicates --------------------------------------------------------

def brute_sets(many, words):
    out = []
    for t in many:
        w = WORDS.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append(set(zip(*(w[k:] for k in range(words)))) if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_components(many, words):
    sets = brute_sets(many, words)
    parent = list(range(len(many)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(many))], list(map(len, sets))


def copies(seed):
    """Groups of copies with all degrees of likeness, chained as well."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6)))
    out = []
    for size in (2, 3, 8, 30):
        now = [word() for _ in range(random.randint(40, 200))]
        for _ in range(size):
            out.append(" ".join(now))
            if random.random() < 0.5:
                now = list(now)
            for _ in range(random.randint(0, 9)):
                now[random.randrange(len(now))] = word()
    random.shuffle(out)
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_groups(spark, words):
    many = [None, "", "one", "One", "one two", "ONE TWO", *copies(words), *texts()[:60], *ODD]
    want, sizes = brute_components(many, words)
    got = {r.doc_id: r for r in minhash.grouped(clashing(rows(spark, many)), words=words, block=4).collect()}
    assert [got[i].n_shingles for i in range(len(many))] == sizes
    assert [got[i].component_id for i in range(len(many))] == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_links_short_copies_at_the_threshold(spark):
    random.seed(11)
    many = []
    for shared, of, pairs in ((4, 5, 300), (8, 10, 150), (12, 15, 100), (16, 20, 100), (24, 30, 100)):
        for k in range(pairs):
            w = [f"w{of}x{k}x{random.randrange(10**6)}y{j}" for j in range(of + 1)]
            many += [" ".join(w[: shared + 1]), " ".join(w)]
    got = {r.doc_id: r.component_id for r in minhash.grouped(rows(spark, many), words=2).collect()}
    assert [got[i] for i in range(len(many))] == [i - i % 2 for i in range(len(many))]


def test_minhash_sketch_rules_out_large_sets_only(spark):
    def found(n, bits):
        sets = [np.arange(n, dtype=np.uint64), np.arange(n * 4 // 5, dtype=np.uint64)]
        members = [(1, 0, 0, 0, bytes(15) + bytes([i]), bytes(15) + bytes([i]), len(x), b, b, [7], 0, x.tobytes()) for i, x, b in zip((1, 2), sets, (0, bits))]
        columns = [pa.array(list(c)) for c in zip(*members)]
        batch = pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])
        near = spark.range(1).select(minhash.plausible(*map(F.lit, (0, 0, n, bits, bits, n * 4 // 5)), 80).alias("near")).first().near
        return [p["sure"] for b in minhash._in_blocks(80)(iter([batch])) for p in b.to_pylist()], near

    assert found(30, -1) == ([True], True)
    assert found(5 * minhash.SKETCH_LEAST, -1) == ([], False)
    assert found(5 * minhash.SKETCH_LEAST, 1) == ([False], True)  # its full sets are still to be compared


def test_minhash_finds_every_link_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    many = [r.text for r in docs.orderBy("doc_id").collect()]
    want, _ = brute_components(many, 2)
    got = {r.doc_id: r.component_id for r in minhash.grouped(docs, words=2).collect()}
    assert [got[i] for i in range(len(many))] == want


def test_one_of_each_keeps_other_texts_of_a_doc_id(spark):
    data = [(1, "alpha beta gamma delta one two three"), (1, "quite another text that has its own words"), (2, "alpha beta gamma delta one two three"), (1, "alpha beta gamma delta one two three"), (3, None), (3, " "), (3, None), (None, "x"), (None, "x")]
    got = minhash.one_of_each(spark.createDataFrame(data, "doc_id bigint, text string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [data[0], data[1], (3, None), (3, " "), (None, "x"), (None, "x")]))


def test_minhash_edges(spark):
    assert minhash.grouped(rows(spark, [])).count() == 0
    df = rows(spark, ["same text in both", "same text in both", "other"])
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert all(r.kept and r.component_id is None for r in minhash.grouped(nulls).collect())
    left = minhash.one_of_each(df.union(df))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2] and left.columns == df.columns


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# ---- fingerprints -----------------------------------------------------------

def test_fingerprints_against_brute_force(spark):
    many = [None, "", *ODD, *texts()[:40], "y" * 150_000]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(clashing(rows(spark, many)), bucket_docs=7).collect()}
    of = lambda t: fingerprints.Document(0, t).fingerprint
    assert len(got) == len(many)
    for i, t in enumerate(many):
        t, nxt = t or "", many[i - 1] or ""  # after the last, id 0, comes the first
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (of(t), of(edited))
        assert r.near_edited == fingerprints.likeness(of(t), of(edited)) and r.near_next == fingerprints.likeness(of(t), of(nxt))
        if len(t) > 100 and edited != t:
            assert 0.55 < r.near_edited < 0.8
    assert fingerprints.fingerprinted(rows(spark, [])).count() == 0
    twins = fingerprints.fingerprinted(rows(spark, ["same", "same"])).collect()
    assert {r.near_next for r in twins} == {1.0}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=300), st.text(alphabet="abc", max_size=300))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fingerprints.Document(0, a).fingerprint, fingerprints.Document(0, b).fingerprint
    near = fingerprints.likeness(x, y)
    assert 0 <= near <= 1 and near == fingerprints.likeness(y, x) and (near == 1) >= (a == b)
    front = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    back = next((i for i, (p, q) in enumerate(zip(a[::-1], b[::-1])) if p != q), min(len(a), len(b)))
    if a != b:
        assert near <= (front + back) / max(len(a), len(b), 1) + 1e-9


def common(a, b):
    return next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


def brute_shared(a, b):
    w = min(16, len(a), len(b))
    if not w:
        return float(a == b)
    cover = lambda s, t: len({i + k for i in range(len(s) - w + 1) if s[i : i + w] in t for k in range(w)})
    return (cover(a, b) + cover(b, a)) / (len(a) + len(b))


def prefixes(t):
    return fingerprints.Document(0, t).prefixes


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", max_size=90), st.text(alphabet="ab", max_size=90), st.data())
def test_spans_and_extensions_are_exact(a, b, data):
    x, y = prefixes(a), prefixes(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    assert fingerprints.forward(x, i, y, j) == common(a[i:], b[j:])
    assert fingerprints.backward(x, i, y, j) == common(a[:i][::-1], b[:j][::-1])
    k = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert fingerprints.equal_spans(x, i, y, j, k) == (a[i : i + k] == b[j : j + k])
    assert abs(fingerprints.shared(x, y) - brute_shared(a, b)) < 1e-12


def test_likeness_of_spans_goes_on_after_mismatches(spark):
    random.seed(3)
    a = "".join(random.choice("abcdefgh") for _ in range(140_000))
    b = a[:4000] + "-" + a[4000:70_000] + "+" + a[70_001:-3] + "?" + a[-2:]
    many = ["", "tail", *texts()[:25], b, a]
    got = {r.doc_id: r for r in fingerprints.fingerprinted(rows(spark, many)).collect()}
    r = got[len(many) - 1]
    assert (r.near_next, r.front_next, r.back_next) == (0.0, 4000, 2) and r.shared_next > 0.999
    for i, t in enumerate(many):
        nxt, r = many[i - 1], got[i]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        assert (r.front_edited, r.back_edited) == (common(t, edited), common(t[::-1], edited[::-1])), i
        assert (r.front_next, r.back_next) == (common(t, nxt), common(t[::-1], nxt[::-1])), i
        if max(len(t), len(nxt)) < 5000:
            assert abs(r.shared_next - brute_shared(t, nxt)) < 1e-12, i


def test_fingerprints_of_null_ids_and_long_texts(spark):
    data = [(None, "first"), (None, "second one"), (None, "second one"), (9, "z" * 300_000), (9, "w" * 200_000), (4, None)]
    got = fingerprints.fingerprinted(spark.createDataFrame(data, "doc_id bigint, text string"), bucket_docs=2).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in data)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.fingerprint for r in got if r.n_chars == 10}
    assert len(same) == 1


# ---- language ---------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 4 = 0")
    model = language_id.fit(train.select("doc_id", "text", F.col("lang").alias("language")), rows=300)
    bare = language_id.of_documents(test, model).withColumn("declared", F.lit(None).cast("string")).withColumn("host", F.lit(None).cast("string"))
    got = language_id.identified(bare, model).join(test.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert sum(r.lang == r.true for r in got) >= 0.97 * len(got)


def test_language_evidence(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = language_id.fit(docs.select("doc_id", "text", F.col("lang").alias("language")))
    data = [(i, r.text, f"www.{r.lang}.site.org", "org", r.lang) for i, r in enumerate(docs.filter("n_chars > 300").collect())]
    n = len(data)
    data += [(n, "ab", "www.fr.site.org", None, "fr"), (n + 1, None, None, None, None), (n + 2, "12 34 !!", "www.fr.site.org", "org", "fr"), (n + 3, "xq", None, None, None)]
    rows_ = spark.createDataFrame(data, "doc_id bigint, text string, host string, suffix string, declared string")
    got = {r.doc_id: r for r in language_id.identified(rows_, model).collect()}
    assert got[n].lang == "fr" and got[n].kept  # two letters: host and declaration decide
    assert got[n + 1].lang is None and not got[n + 1].kept and got[n + 2].lang is None and not got[n + 2].kept
    assert len(got) == len(data) and got[n + 3].lang is not None
    none = language_id.accepted(rows(spark, []))
    assert none.count() == 0
    pages = language_id.identified(language_id.of_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")), model)
    assert pages.filter("kept").count() > 45


def slow_language(rows_, model):
    """The fused posterior of each row, in plain Python."""
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    low = lambda b: b + 32 if 65 <= b <= 90 else b
    many, told = len(model.languages), []
    for r in rows_:
        raw = b" " + (r.text or "").encode() + b" "
        grams = [(((low(raw[i - 1]) << 16 | low(raw[i]) << 8 | low(raw[i + 1])) * 2654435761) % 2**32) >> 17 for i in range(1, len(raw) - 1) if letter(raw[i])]
        n = len(grams)
        told.append((r, n, [sum(float(model.table[k, g]) for g in grams) * 60 / (60 + n) for k in range(many)]))
    best = [max(range(many), key=lambda k: (ll[k], -k)) if n else None for _, n, ll in told]
    overall = [1.0 + sum(b == k for b in best) for k in range(many)]
    flat = [x / sum(overall) for x in overall]

    def tally(key, value):
        return [sum(b == k and key(r) == value for (r, _, _), b in zip(told, best)) for k in range(many)]

    parent = lambda r: r.host and ".".join(r.host.split(".")[-2:])
    share = lambda w: [x / sum(w) for x in w]
    out = {}
    for (r, n, ll), b in zip(told, best):
        prior = flat
        if r.host is not None and any(tally(lambda x: x.host, r.host)):
            above = share([c + 20 * p for c, p in zip(tally(parent, parent(r)), flat)])
            prior = share([c + 20 * p for c, p in zip(tally(lambda x: x.host, r.host), above)])
        total = [x + math.log(p) for x, p in zip(ll, prior)]
        for key in ("suffix", "declared"):
            value = getattr(r, key)
            if value is not None and any(found := tally(lambda x: getattr(x, key), value)):  # noqa: B023
                total = [x + math.log((c + 0.5) / (t + 1.0)) for x, c, t in zip(total, found, overall)]
        most = max(total)
        out[r.doc_id] = (model.languages[total.index(most)], 1 / sum(math.exp(x - most) for x in total)) if n else (None, 0.0)
    return out


def test_language_fusion_against_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.select("doc_id", "text", F.col("lang").alias("language")), rows=60)
    pages = language_id.of_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    odd = spark.createDataFrame([(900, "xq zz", "a.b.site.org", "org", "de"), (901, "xq zz", "a.b.site.org", "org", "de"), (902, None, "a.b.site.org", None, None), (903, "la la", None, None, "unheard"), (904, "La casa y la mesa. " * 3000, "c.b.site.org", None, None)], pages.schema)
    rows_ = pages.unionByName(odd)
    got = {r.doc_id: r for r in language_id.identified(rows_.withColumn("top", F.lit("x")).withColumn("n", F.lit(1)), model).collect()}
    want = slow_language(rows_.collect(), model)
    assert len({r.host for r in rows_.collect()}) > 3 and len(got) == len(want)
    for i, (lang, confidence) in want.items():
        assert got[i].lang == lang and abs(got[i].confidence - confidence) < 1e-3, i


def test_language_label_is_no_declaration(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = language_id.fit(docs.select("doc_id", "text", F.col("lang").alias("language")), rows=50)
    evidence = language_id.of_documents(docs, model)
    assert evidence.filter("declared IS NULL").count() == 50 and evidence.filter("declared IS NOT NULL").count() == docs.count() - 50
    many = [(i, f"text number {i} of {i}", f"l{i:03}") for i in range(90)]
    assert len(language_id.fit(spark.createDataFrame(many, "doc_id bigint, text string, language string")).languages) == 90


# ---- pipeline ---------------------------------------------------------------

def test_pipeline_on_odd_tables(spark, tmp_path):
    text = lambda k: " ".join(f"the{k}w{i}" for i in range(70)) + "."
    data = [(1, text("a")), (1, text("a")), (None, text("b")), (2, text("c")), (3, None), (4, ""), (1, text("d") + " And a few more.")]
    for name, made in (("odd", data), ("empty", [])):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        clashing(df).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert (sorted({r.doc_id for r in got}, key=str) == [1, 2, None]) if made else not got
    assert len({(r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect() if r.doc_id == 1}) == 2


def test_pipeline_against_brute_force(spark, tmp_path):
    many = [t for t in texts() if t][:90] + copies(7)[:20] + [None, "", "12345 678"]
    passage = "This sentence is long enough to count as a passage that is repeated across documents, word for word, without any change at all, so that every byte of it has to go from each of the texts that hold it, here and there. "
    many += [f"{a} {passage}{a} ends here." for a in (" ".join(f"w{i}{j}" for j in range(60)) for i in range(3))]
    folder = f"{tmp_path}/documents.parquet"
    rows(spark, many).write.parquet(folder)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Language identification leaves what has letters.
    left = {i: t for i, t in enumerate(many) if t and re.search(r"[A-Za-z\x80-\U0010ffff]", t)}
    left = {i: brute_clean(t) for i, t in left.items() if brute_kept(t)}
    ids = sorted(left)
    groups, _ = brute_components([left[i] for i in ids], 5)
    ids = [i for k, i in enumerate(ids) if groups[k] == k]
    raw = {i: left[i].encode() for i in ids}
    seen = Counter(t[s : s + 200] for t in raw.values() for s in range(len(t) - 199))
    for i, t in raw.items():
        gone = {s + k for s in range(len(t) - 199) if seen[t[s : s + 200]] > 1 for k in range(200)}
        raw[i] = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
    lib = library(vocabulary_path(BYTE_BPE))
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in raw.items()}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(total) == want and any(len(raw[i]) < len(left[i]) for i in ids)
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
