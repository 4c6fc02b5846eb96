"""Secrets in texts: three patterns, and strings that look random.

The patterns' spans always count. Beside them every run of token characters is
judged by two Markov chains over characters, one of random strings and one of
ordinary identifiers: where the first explains a run so much better that it
outweighs how rare secrets are, the run is a span too, unless it overlaps a
pattern's. Both chains are trained here: random strings are what the patterns find
in all documents, identifiers are the runs that are left in a sample of documents
once the patterns' matches are taken out. Half of the first chain's mass is spread
evenly, since secrets of other makes use other characters. Differences of
log-likelihoods are whole thousandths, so a run's sum does not depend on any order.

All of it is column expressions: no Python worker, no shuffle of texts. A span's
place follows from the lengths of what lies between matches, summed up in doubling
steps, so a text with very many matches costs n log n.

Defined results: a null or empty text has no spans. Repeated rows are judged alike
and all returned, rows with a null doc_id too. Spans of one start are in the order
of the kinds. Very long texts are searched whole. An empty table gives none (and a
chain without samples is even); further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

#: The patterns of the kinds. Equal runs of fewer characters never count, so the last two have their least lengths inside.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
#: Fixed value: one of these is in every match of the first pattern, in lower case.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE = 12
TOKEN = "A-Za-z0-9+/_=-"
#: Characters of a run that is judged, and of one that trains identifiers.
LEAST_RUN, LEAST_IDENTIFIER = 16, 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents whose runs train identifiers; the share of the random chain that is even; what is added to each count; thousandths of a nat that a run needs (one run in ten thousand is random).
SAMPLE, EVEN, ADDED, NEEDED = 2000, 0.5, 0.5, 9210
KINDS = ("assign", "access", "hex", "random")


def run(least: int) -> str:
    return f"(?<![{TOKEN}])[{TOKEN}]{{{least},}}"


def running(a: Column, step, zero: Column) -> Column:
    """An array of whole numbers' running values under ``step``, in doubling steps."""
    turns = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int") - 1))
    shifted = lambda acc, k: F.slice(F.concat(F.array_repeat(zero, F.call_function("shiftleft", F.lit(1), k)), acc), F.lit(1), F.size(acc))
    return F.aggregate(turns, a, lambda acc, k: F.zip_with(acc, shifted(acc, k), step))


def _matched(text: Column, pattern: str, group: int, gate: Column) -> Column:
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def found(docs: DataFrame) -> DataFrame:
    """The rows with what the patterns match (``_assign``, ``_value``,
    ``_access``, ``_hex``), before values are measured."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_low", F.lower("text"))
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | F.contains("_low", F.lit(word))
    text = F.col("text")
    df = df.withColumn("_assign", _matched(text, ASSIGN, 0, named)).drop("_low")
    df = df.withColumn("_value", _matched(text, ASSIGN, 1, F.size("_assign") > 0))
    df = df.withColumn("_access", _matched(text, ACCESS, 0, F.contains("text", F.lit("AKIA"))))
    return df.withColumn("_hex", _matched(text, HEX, 0, F.lit(True)))


def pairs(strings: DataFrame) -> DataFrame:
    """(a, b, n): characters that follow each other in strings (s), the start of
    a string as ``^``."""
    chars = strings.select(F.split("s", "").alias("c")).select(F.filter("c", lambda x: x != "").alias("c"))
    both = F.zip_with(F.concat(F.array(F.lit("^")), F.slice("c", F.lit(1), F.size("c") - 1)), "c", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return chars.filter(F.size("c") > 0).select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """The texts of the ``sample`` different documents with the least hashes. Only
    hashes below a bound that few can reach are compared, so no task meets more of
    them as the table grows, and copies are one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select(text.alias("text"), F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256).alias("h"))
    n, many = docs.count(), 4 * sample
    while True:
        top = F.lit("g" if many >= n else f"{int(many / n * 16**15):015x}")  # "g" comes after all digits
        few = stored(hashed.filter(F.col("h") < top).select("h").distinct(), "least-hashes")
        if many >= n or few.count() >= sample:
            break
        many *= 16  # most rows are copies
    last = few.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return hashed.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text")).select("text")


def samples(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Strings (s) labelled as random, of all documents, and as identifiers, of
    the ``sample`` different documents with the least hashes of id and text."""
    matched = found(docs)
    long = F.filter("_value", lambda v: F.length(v) >= LEAST_VALUE)
    known = matched.select(F.explode(F.concat(long, "_access", "_hex")).alias("s")).select(F.regexp_replace("s", rf"[^{TOKEN}]+", "").alias("s"))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    return known, sampled(docs, sample).select(F.explode(F.regexp_extract_all(rest, F.lit(run(LEAST_IDENTIFIER)), F.lit(0))).alias("s"))


def ratios(random: DataFrame, ordinary: DataFrame) -> list[int]:
    """Thousandths of a nat by which each character after each other, or after
    the start, speaks for random strings. What is gathered is bounded by the
    alphabet's square."""
    size = len(ALPHABET)
    counts = []
    for strings in (random, ordinary):
        table = {(r.a, r.b): r.n for r in pairs(strings).collect()}
        counts.append([[table.get((a, b), 0) for b in ALPHABET] for a in "^" + ALPHABET])
    out = []
    for x, y in zip(*counts):
        n, m = sum(x), sum(y)
        for i in range(size):
            one = (1 - EVEN) * (x[i] / n if n else 1.0 / size) + EVEN / size
            other = (y[i] + ADDED) / (m + ADDED * size)
            out.append(math.floor(1000 * (math.log(one) - math.log(other)) + 0.5))
    return out


def _starts(kind: str) -> Column:
    """Where a kind's matches start: what lies before each, and the matches before."""
    before = F.slice(f"_gaps_{kind}", F.lit(1), F.size(f"_{kind}"))
    sizes = F.concat(F.array(F.lit(0)), F.transform(f"_{kind}", lambda m: F.length(m)))
    return running(F.zip_with(before, F.slice(sizes, F.lit(1), F.size(f"_{kind}")), lambda g, m: g + m), lambda a, b: a + b, F.lit(0))


def scanned(docs: DataFrame, table: list[int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans of every
    row; spans: start, place of the kind, end. ``table``: ``ratios`` of another
    corpus, or None to train on these documents."""
    table = table if table is not None else ratios(*samples(docs))
    # Folded to one constant array when the query is planned.
    llr = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    df = found(docs).withColumn("_random", _matched(F.col("text"), run(LEAST_RUN), 0, F.lit(True)))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, run(LEAST_RUN))):
        gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        df = df.withColumn(f"_gaps_{kind}", F.when(F.size(f"_{kind}") > 0, gaps).otherwise(F.array().cast("array<int>")))
    df = df.drop("text")
    for kind in KINDS:
        df = df.withColumn(f"_at_{kind}", _starts(kind))
    span = lambda kind: lambda at, m: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + F.length(m)).alias("end"))
    base = {k: F.zip_with(f"_at_{k}", f"_{k}", span(k)) for k in KINDS}
    kept = F.zip_with(base["assign"], "_value", lambda s, v: F.when(F.length(v) >= LEAST_VALUE, s))
    base["assign"] = F.filter(kept, lambda s: s.isNotNull())

    def sum_of(word: Column) -> Column:
        chars = F.filter(F.split(word, ""), lambda x: x != "")
        row = F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)))
        column = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c))
        both = F.zip_with(F.slice(row, F.lit(1), F.size(chars)), column, lambda a, b: F.element_at(llr, a * len(ALPHABET) + b))
        return F.aggregate(both, F.lit(0), lambda total, x: total + x)

    scores = F.transform("_random", sum_of)
    judged = F.zip_with(base["random"], scores, lambda s, x: F.when(x >= NEEDED, s))
    df = df.select("doc_id", base["assign"].alias("_a"), base["access"].alias("_k"), base["hex"].alias("_h"), F.filter(judged, lambda s: s.isNotNull()).alias("_r"))
    df = df.withColumn("base_spans", F.array_sort(F.concat("_a", "_k", "_h"))).withColumn("_all", F.array_sort(F.concat("_a", "_k", "_h", "_r")))
    own = len(KINDS) - 1
    # How far the patterns' spans before reach, and where the next one after starts.
    ends = F.transform("_all", lambda s: F.when(s["kind"] < own, s["end"]).otherwise(F.lit(0)))
    heads = F.reverse(F.transform("_all", lambda s: F.when(s["kind"] < own, s["start"]).otherwise(F.lit((1 << 31) - 1))))
    df = df.withColumn("_ends", ends).withColumn("_heads", heads)
    df = df.withColumn("_reach", running(F.col("_ends"), lambda a, b: F.greatest(a, b), F.lit(0))).withColumn("_ahead", F.reverse(running(F.col("_heads"), lambda a, b: F.least(a, b), F.lit((1 << 31) - 1))))
    near = F.zip_with(F.zip_with("_all", "_reach", lambda s, r: F.struct(s.alias("s"), r.alias("r"))), "_ahead", lambda x, h: F.when((x["s"]["kind"] < own) | ((x["r"] <= x["s"]["start"]) & (h >= x["s"]["end"])), x["s"]))
    df = df.withColumn("spans", F.filter(near, lambda s: s.isNotNull()))
    n = lambda c: F.size(c).cast("long")
    return df.select("doc_id", n("_a").alias("n_assign"), n("_k").alias("n_access"), n("_h").alias("n_hex"), (n("spans") - n("base_spans")).alias("n_random"), "base_spans", "spans")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = scanned(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


_q = lambda x: "'" + x.replace("'", "''") + "'"
_RUN = lambda n: f"[{TOKEN}]{{{n},}}"
_FOUND = lambda i, pattern: f"""{KINDS[i]}_m AS (SELECT r, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM (SELECT r, regexp_extract_all(text, {_q(pattern)}) AS m, regexp_extract_all(text, {_q(pattern)}, {int(i == 0)}) AS v, list_transform(string_split_regex(text, {_q(pattern)}), lambda x: length(x)) AS g FROM d)),
{KINDS[i]}_s AS (SELECT r, m, v, {i} AS kind, (sum(g + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m))::BIGINT AS start FROM {KINDS[i]}_m)"""  # noqa: E731
_PAIRS = lambda name, source: f"""{name}_c AS (SELECT k, unnest(string_split(s, '')) AS b, generate_subscripts(string_split(s, ''), 1) AS i FROM (SELECT row_number() OVER () AS k, s FROM {source} WHERE s <> '')),
{name}_p AS (SELECT a, b, count(*) AS n FROM (SELECT coalesce(lag(b) OVER (PARTITION BY k ORDER BY i), '^') AS a, b FROM {name}_c) GROUP BY ALL)"""  # noqa: E731
ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{', '.join(_FOUND(i, p) for i, p in enumerate((ASSIGN, ACCESS, HEX, _RUN(LEAST_RUN))))},
base AS (SELECT r, kind, start, start + length(m) AS stop, v FROM assign_s WHERE length(v) >= {LEAST_VALUE} UNION ALL SELECT r, kind, start, start + length(m), m FROM access_s UNION ALL SELECT r, kind, start, start + length(m), m FROM hex_s),
x AS (SELECT regexp_replace(v, '[^{TOKEN}]+', '', 'g') AS s FROM base),
few AS (SELECT text FROM (SELECT DISTINCT doc_id, text FROM d) ORDER BY sha256(coalesce(doc_id::VARCHAR, '') || ':' || text) LIMIT {SAMPLE}),
y AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, {_q(ASSIGN)}, ' ', 'g'), '{ACCESS}', ' ', 'g'), '{HEX}', ' ', 'g'), '{_RUN(LEAST_IDENTIFIER)}')) AS s FROM few),
{_PAIRS('x', 'x')}, {_PAIRS('y', 'y')},
al AS (SELECT unnest(string_split('{ALPHABET}', '')) AS b), grid AS (SELECT a, b FROM (SELECT b AS a FROM al UNION ALL SELECT '^') CROSS JOIN al),
cnt AS (SELECT a, b, coalesce(x_p.n, 0) AS xn, coalesce(y_p.n, 0) AS yn FROM grid LEFT JOIN x_p USING (a, b) LEFT JOIN y_p USING (a, b)),
tot AS (SELECT *, sum(xn) OVER (PARTITION BY a) AS xs, sum(yn) OVER (PARTITION BY a) AS ys FROM cnt),
llr AS (SELECT a, b, floor(1000 * (ln({1 - EVEN}::DOUBLE * (CASE WHEN xs = 0 THEN 1::DOUBLE / {len(ALPHABET)} ELSE xn::DOUBLE / xs END) + {EVEN}::DOUBLE / {len(ALPHABET)}) - ln((yn + {ADDED}::DOUBLE) / (ys + {ADDED}::DOUBLE * {len(ALPHABET)}))) + 0.5::DOUBLE)::BIGINT AS w FROM tot),
cand AS (SELECT row_number() OVER () AS s, r, start, start + length(m) AS stop, m FROM random_s),
ch AS (SELECT s, unnest(string_split(m, '')) AS b, generate_subscripts(string_split(m, ''), 1) AS i FROM cand),
pr AS (SELECT s, coalesce(lag(b) OVER (PARTITION BY s ORDER BY i), '^') AS a, b FROM ch),
sc AS (SELECT s FROM pr JOIN llr USING (a, b) GROUP BY s HAVING sum(w) >= {NEEDED}),
more AS (SELECT r, 3 AS kind, start, stop FROM cand JOIN sc USING (s) WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = cand.r AND base.start < cand.stop AND cand.start < base.stop)),
named AS (SELECT r, kind, start, [{', '.join(map(_q, KINDS))}][kind + 1] || ':' || start || ':' || stop AS t FROM (SELECT r, kind, start, stop FROM base UNION ALL SELECT * FROM more)),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
  string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""
