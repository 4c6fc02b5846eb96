"""A hashed maximum-entropy language model, trained and applied to a corpus.

Words are symbols: the ``NAMED`` most frequent training words (the end of a text
among them) have one each, all others are the outcome *rare*. The softmax is
factored by class: a symbol is a path of ``DEPTH`` choices among ``BRANCH``, from
class to member, and each choice has its own softmax given the choices before
it. Features of a choice are the word before, the two words before together
(n-grams) and, for the class, the second word before alone (skip); each, together
with the choices made so far, is hashed to one of ``ROWS`` rows of weights, one
weight for each outcome. As features, rare words are told apart by hash. A rare
word has the probability of *rare* times its add-one share among rare words.

1. Texts are coded in blocks: a block's distinct words with their number in
   training texts, and every token's place among them.
2. Words are counted over all blocks by one window; the counts go back by block
   and place, without the words.
3. Weights are trained by distributed gradient updates. Every training token is
   used once, in one of ``ROUNDS`` rounds. A round's tasks start from the broadcast
   weights, whose size is a parameter, take sparse steps over their blocks and
   return the rows they touched; a row becomes the mean of what the tasks made
   of it, weighted by how often each met it.
4. Blocks are scored in numpy batches.

Defined results: a null or empty text is one end token; rows with equal or null
doc_id are scored each for itself (a null id counts as the empty text where
training texts are chosen); an empty table gives none, and without training
documents all counts are 0. A very long text is a block of its own and is scored
in batches. Of words about as frequent as the last that has a path, those of
least hash have one. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, documents, slices, stored

FOLDS, HELD_OUT = 7, 2
#: Outcomes of a choice, choices to a word; the class that stands for all rare words; symbols with a path of their own.
BRANCH, DEPTH = 16, 4
RARE_CLASS = BRANCH - 1
NAMED = RARE_CLASS * BRANCH ** (DEPTH - 1)
#: Context symbols are 16 bits: those above ``NAMED`` are shared by rare words.
CONTEXTS = 1 << 16
START = CONTEXTS  # before a text
ROW_BITS = 18
ROWS = 1 << ROW_BITS
ROUNDS, RATE = 2, 0.6
#: No outcome's score is further from 0.
LIMIT = 40.0
#: Tokens in a step, in a block, and in a training task (on average).
STEP, BLOCK_TOKENS, TASK_TOKENS = 8192, 1 << 21, 5_000_000
#: Rows of weights that travel together.
GROUP = 1024
END = "\n"  # no word contains it
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")
_ONES = np.ones(BRANCH, np.float32)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


# ---- coding -----------------------------------------------------------------

def tokens(texts: list[bytes]) -> pa.DictionaryArray:
    """The lower-cased words of texts and an end after each, coded."""
    joined = b"".join([t.translate(_FOLD) + b" \n " for t in texts])
    whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, len(joined)], np.int64)), pa.py_buffer(joined))
    found = pc.split_pattern(whole, " ").flatten()
    return found.filter(pc.not_equal(found, "")).cast(pa.string()).dictionary_encode()


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _from_planes(raw: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw, n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


CODED = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, codes binary, words array<string>, counts array<bigint>"
_CODED = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _coded(block_tokens: int):
    def close(number: int, ids: list, parts: list):
        parts = pa.chunked_array(parts).unify_dictionaries()
        words = parts.chunk(0).dictionary
        codes = np.concatenate([p.indices.to_numpy() for p in parts.chunks])
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        codes, words = place[codes], words.take(pa.array(order))
        last = np.flatnonzero(codes == pc.index(words, END).as_py())
        sizes = np.diff(last, prepend=-1)
        held = np.array([held_out(d) for d in ids])
        counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
        block = TaskContext.get().partitionId() << 24 | number
        return batch_of(_CODED, {"block": [block], "doc_ids": [ids], "held": [held.tolist()], "sizes": [sizes], "codes": [_planes(codes)], "words": [words], "counts": [counts]})

    def run(batches):
        ids, parts, size, number = [], [], 0, 0
        for batch in slices(batches, "text"):
            found = tokens([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            if parts and size + len(found) > block_tokens:
                yield close(number, ids, parts)
                ids, parts, size, number = [], [], 0, number + 1
            ids += batch.column(0).to_pylist()
            parts.append(found)
            size += len(found)
        if parts:
            yield close(number, ids, parts)

    return run


TALLIED = "doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, known array<bigint>, base array<double>, share array<double>, symbols binary"
_TALLIED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("share", pa.list_(pa.float64())), ("symbols", pa.binary())])


def context_symbol(word: bytes) -> int:
    """What a rare word is as a feature."""
    return NAMED + zlib.crc32(word) % (CONTEXTS - NAMED)


def _tallied(named: list[str], n: int, v: int, rare: int):
    """Per block: symbols of all tokens, and of each text what counts alone tell.
    ``n`` tokens and ``v`` words are known, ``rare`` is the denominator of rare words' shares."""

    def run(key, left, right):
        if not left.num_rows:
            return _TALLIED.empty_table()
        row = {c: left[c][0] for c in ("doc_ids", "held", "sizes")}
        sizes = row["sizes"].values.to_numpy()
        words = left["words"][0].values
        codes = _from_planes(left["codes"][0].as_py(), int(sizes.sum()), np.int32)
        c = np.zeros(len(words), np.int64)
        c[right["pos"].to_numpy()] = right["total"].to_numpy()
        at = pc.index_in(words, value_set=pa.array(named, pa.string()))
        symbol = at.fill_null(-1).to_numpy().astype(np.int64)
        others = np.flatnonzero(symbol < 0)
        symbol[others] = [context_symbol(w) for w in words.take(pa.array(others)).cast(pa.binary()).to_pylist()]
        share = np.where(symbol >= NAMED, np.log10((c + 1) / rare), 0.0)
        first = np.cumsum(sizes) - sizes
        each = lambda x: np.add.reduceat(x[codes], first)
        out = {"known": each((c > 0).astype(np.int64)), "base": each(np.log10((c + 1) / (n + v + 1))), "share": each(share)}
        return pa.table({k: [x.as_py()] for k, x in row.items()} | {k: [x] for k, x in out.items()} | {"symbols": [_planes(symbol.astype(np.uint16)[codes])]}, schema=_TALLIED)

    return run


# ---- the model --------------------------------------------------------------

def contexts(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second symbol before each token, and the one before; texts lie end to end."""
    s = symbols.astype(np.int64)
    before = np.concatenate(([START], s[:-1]))
    second = np.concatenate(([START, START], s[:-2]))[: len(s)]
    first = np.cumsum(sizes) - sizes
    before[first] = second[first] = START
    second[(first + 1)[sizes > 1]] = START
    return second, before


def choices(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each choice from the class on: which tokens make it, at which node, and what."""
    s = np.minimum(symbols.astype(np.int64), NAMED)
    who, out, node, size = np.arange(len(s)), [], np.zeros(len(s), np.int64), BRANCH ** (DEPTH - 1)
    for level in range(DEPTH):
        made = s // size % BRANCH
        out.append((who, node, made))
        if not level:
            keep = made < RARE_CLASS
            who, node, made, s = who[keep], node[keep], made[keep], s[keep]
        node = node * BRANCH + 1 + made
        size //= BRANCH
    return out


def hashed_features(second: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    a, b = before.astype(np.uint64), second.astype(np.uint64)
    return [a * _KINDS[0] + np.uint64(1), (b * np.uint64(CONTEXTS + 1) + a) * _KINDS[1] + np.uint64(2), b * _KINDS[2] + np.uint64(3)]


def rows_of(features: list[np.ndarray], who: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """The rows of weights of some tokens' choice; the skip feature is the class's alone."""
    return [weight_rows(f[who], node) for f in (features if len(who) and not node[0] else features[:2])]


def weight_rows(feature: np.ndarray, node: np.ndarray) -> np.ndarray:
    x = feature ^ (node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def biases(counts: np.ndarray) -> np.ndarray:
    """Log shares of outcomes at each node, from the symbols' training counts;
    the last count is that of all rare words."""
    rare = BRANCH ** (DEPTH - 1)
    leaf, out = np.concatenate((counts[:NAMED] + 0.5, np.full(rare, (counts[NAMED] + 0.5) / rare))), []
    while len(leaf) > 1:
        leaf = leaf.reshape(-1, BRANCH)
        out.insert(0, np.log(leaf / leaf.sum(axis=1, keepdims=True)))
        leaf = leaf.sum(axis=1)
    return np.concatenate(out).astype(np.float32)


def outcomes(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """Scores of all outcomes, between plus and minus ``LIMIT``."""
    z = bias.take(node, axis=0)
    for r in rows:
        z += weights.take(r, axis=0)
    return np.clip(z, -LIMIT, LIMIT, out=z)


def log_probabilities(weights: np.ndarray, bias: np.ndarray, symbols: np.ndarray, second: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 of each token's symbol after its context."""
    out = np.zeros(len(symbols))
    features = hashed_features(second, before)
    for who, node, made in choices(symbols):
        z = outcomes(weights, bias, rows_of(features, who, node), node)
        chosen = z[np.arange(len(who)), made].astype(np.float64)
        out[who] += chosen - np.log(np.exp(z, out=z) @ _ONES)
    return out / np.log(10)


def gradients(weights: np.ndarray, bias: np.ndarray, symbols: np.ndarray, second: np.ndarray, before: np.ndarray):
    """For each kind of choice: the rows that these tokens' features touch, how
    often, and the log-likelihood's gradient in each."""
    features = hashed_features(second, before)
    for who, node, made in choices(symbols):
        if not len(who):
            continue
        rows = rows_of(features, who, node)
        g = outcomes(weights, bias, rows, node)
        np.exp(g, out=g)
        g *= (-1 / (g @ _ONES))[:, None]
        g[np.arange(len(who)), made] += 1
        flat = np.concatenate(rows)
        order = np.argsort(flat)
        flat = flat[order]
        start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        token, times = order % len(who), np.diff(start, append=len(flat))
        total = g.take(token[start], axis=0)
        more = np.flatnonzero(times > 1)
        if len(more):  # rows met more than once are summed
            n = times[more]
            begin = np.cumsum(n) - n
            at = np.repeat(start[more] - begin, n) + np.arange(int(n.sum()))
            total[more] = np.add.reduceat(g.take(token[at], axis=0), begin, axis=0)
        yield flat[start], times, total


def step(weights: np.ndarray, squares: np.ndarray, met: np.ndarray, bias: np.ndarray, symbols: np.ndarray, second: np.ndarray, before: np.ndarray, rate: float) -> None:
    """A sparse update in place: a touched row moves by its gradient over the
    root of its squared gradients so far."""
    for touched, times, total in gradients(weights, bias, symbols, second, before):
        squares[touched] += np.einsum("ij,ij->i", total, total)
        met[touched] += times
        total *= (rate / np.sqrt(squares[touched] + 1))[:, None]
        total += weights.take(touched, axis=0)
        weights[touched] = total


_MOVED = pa.schema([("part", pa.int32()), ("met", pa.binary()), ("squares", pa.binary()), ("moved", pa.binary())])
MOVED = "part int, met binary, squares binary, moved binary"


def _updates(model, bias, turn: int, rounds: int, rate: float):
    def run(batches):
        start, squares0 = model.value
        weights = None
        for batch in batches:
            for held, sizes, symbols in zip(*(batch.column(i) for i in range(3))):
                sizes = sizes.values.to_numpy()
                mine = ~np.array(held.as_py(), bool) & (np.arange(len(sizes)) % rounds == turn)
                if not mine.any():
                    continue
                if weights is None:
                    weights, squares, met = start.copy(), squares0.copy(), np.zeros(ROWS, np.float32)
                s = _from_planes(symbols.as_py(), int(sizes.sum()), np.uint16)[np.repeat(mine, sizes)]
                second, before = contexts(s, sizes[mine])
                for i in range(0, len(s), STEP):
                    part = slice(i, i + STEP)
                    step(weights, squares, met, bias, s[part], second[part], before[part], rate)
        if weights is None:
            return
        weights -= start
        squares -= squares0
        for k in np.unique(np.flatnonzero(met) // GROUP).tolist():
            g = slice(k * GROUP, (k + 1) * GROUP)
            yield batch_of(_MOVED, {"part": [k], "met": [met[g].tobytes()], "squares": [squares[g].astype(np.float32).tobytes()], "moved": [weights[g].astype(np.float16).tobytes()]})

    return run


def _mean(batches):
    """Groups of rows, sorted by group: summed squares, and moves weighted by meetings."""

    def done(part, met, squares, moved):
        moved /= np.maximum(met, 1)[:, None]
        return batch_of(_MOVED, {"part": [part], "met": [met.tobytes()], "squares": [squares.tobytes()], "moved": [moved.tobytes()]})

    now = None
    for batch in batches:
        for part, met, squares, moved in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.frombuffer(met, np.float32)
            move = np.frombuffer(moved, np.float16).reshape(-1, BRANCH).astype(np.float32) * n[:, None]
            if part != now:
                if now is not None:
                    yield done(now, *total)  # noqa: F821
                now, total = part, [n.copy(), np.frombuffer(squares, np.float32).copy(), move]
            else:
                for have, new in zip(total, (n, np.frombuffer(squares, np.float32), move)):
                    have += new
    if now is not None:
        yield done(now, *total)


def trained(blocks: DataFrame, bias: np.ndarray, train_tokens: int, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The weights, row by outcome, after all rounds over tallied blocks."""
    spark = blocks.sparkSession
    weights, squares = np.zeros((ROWS, BRANCH), np.float32), np.zeros(ROWS, np.float32)
    if not train_tokens:
        return weights
    tasks = max(1, -(-train_tokens // (rounds * TASK_TOKENS)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = blocks.select("held", "sizes", "symbols").coalesce(tasks)
    for turn in range(rounds):
        model = spark.sparkContext.broadcast((weights, squares))
        moved = data.mapInArrow(_updates(model, bias, turn, rounds, rate), MOVED)
        mean = moved.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_mean, MOVED)
        weights, squares = weights.copy(), squares.copy()
        for r in mean.collect():  # as many rows as the model has, whatever the corpus
            g = slice(r.part * GROUP, (r.part + 1) * GROUP)
            weights[g] += np.frombuffer(r.moved, np.float32).reshape(-1, BRANCH)
            squares[g] += np.frombuffer(r.squares, np.float32)
        model.unpersist()
    return weights


# ---- the corpus -------------------------------------------------------------

OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(model, bias, n: int):
    def run(batches):
        weights = model.value
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"])
                s = _from_planes(row["symbols"], int(sizes.sum()), np.uint16)
                second, before = contexts(s, sizes)
                logs = np.concatenate([log_probabilities(weights, bias, s[i : i + STEP], second[i : i + STEP], before[i : i + STEP]) for i in range(0, len(s), STEP)])
                score = np.add.reduceat(logs, np.cumsum(sizes) - sizes) + np.array(row["share"])
                yield batch_of(_OUT, {"doc_id": row["doc_ids"], "held_out": row["held"], "n_tokens": sizes, "n_known": row["known"], "train_tokens": [n] * len(sizes), "base_score": row["base"], "score": score})

    return run


def frequent(words: DataFrame, most: int) -> list[tuple[str, int]]:
    """The ``most`` most frequent words (word, total), with their totals, in
    order. What comes to the driver is bounded by ``most``: a histogram of totals,
    32 steps to a doubling, tells the step where they end; of the words in it
    those of least hash are taken."""
    level, share = F.floor(F.log2("total") * 32), F.xxhash64("word") / float(1 << 64) + 0.5
    steps = sorted(((r.level, r.n) for r in words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    above, last, part = 0, None, 1.0
    for at, n in steps:
        if above + n > most:
            last, part = at, (1.1 * (most - above) + 100) / n
            break
        above += n
    wanted = words.select("word", "total", level.alias("level"), share.alias("share"))
    if last is not None:
        wanted = wanted.filter((F.col("level") > last) | ((F.col("level") == last) & (F.col("share") < part)))
    found = sorted(wanted.collect(), key=lambda r: (r.level == last, r.share if r.level == last else 0))[:most]
    return sorted(((r.word, r.total) for r in found), key=lambda x: (-x[1], x[0]))


class Corpus:
    """Tallied blocks of a corpus, the named words and the counts."""

    def __init__(self, docs: DataFrame, block_tokens: int = BLOCK_TOKENS):
        coded = stored(docs.select("doc_id", "text").mapInArrow(_coded(block_tokens), CODED), "lm-coded")
        entry = F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "e")
        every = Window.partitionBy("word")
        lexicon = coded.select("block", entry).select("block", "pos", F.col("e.words").alias("word"), F.col("e.counts").alias("c"))
        # A word's count goes to each block that has it; the word itself is kept once.
        total, first = F.sum("c").over(every), F.min("block").over(every) == F.col("block")
        lexicon = stored(lexicon.select("block", "pos", total.alias("total"), F.when(first, F.col("word")).alias("word")), "lm-lexicon")
        known = lexicon.filter("word IS NOT NULL AND total > 0")
        sums = known.agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("total"))).alias("ends")).first()
        self.n, self.v = int(sums["n"] or 0), int(sums["v"])
        top = frequent(known.filter(F.col("word") != END), NAMED - 1)
        self.named = [END, *[w for w, _ in top]]
        counts = np.zeros(NAMED + 1)
        counts[: len(self.named)] = [int(sums["ends"] or 0), *[n for _, n in top]]
        counts[NAMED] = self.n - counts.sum()
        self.bias = biases(counts)
        unseen = max(0, self.v - len(self.named)) + 1
        self.rare = int(counts[NAMED]) + unseen
        tally = _tallied(self.named, self.n, self.v, self.rare)
        self.blocks = stored(coded.groupBy("block").cogroup(lexicon.select("block", "pos", "total").groupBy("block")).applyInArrow(tally, TALLIED), "lm-blocks")


def scored(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    corpus = Corpus(docs, block_tokens)
    weights = trained(corpus.blocks, corpus.bias, corpus.n, rounds)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    return corpus.blocks.mapInArrow(_scores(model, corpus.bias, corpus.n), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
