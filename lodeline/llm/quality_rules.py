"""Quality rules, line first: every line is judged by punctuation, navigation
and boilerplate rules, failing lines go, and a document that loses too much of
its text that way is rejected.

All of it is column expressions on one scan: no shuffle, no Python. Arrays are
only combined with ``zip_with``, never indexed inside a lambda.

Defined results: a null or empty text has no words, so it fails the base rules
and is rejected; its cleaned text is empty. Repeated rows are judged alike and
all returned. A very long text or line is judged whole; an empty table gives none.
Other columns, whatever their names, are ignored by ``judged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_GAP, WORD_GAP

#: Fixed values of the line rules.
TERMINAL = r"""[.!?:;"')\]\x{2026}\x{201d}\x{00bb}\x{3002}][\x20\x09-\x0D]*\z"""
SYMBOLS = r"[#*$%&|<>]"
MARKED = r"[#*$%&|<>][^\x20\x09-\x0D]*"
SHOUTS = r"[!?]{2,}"
SEPARATORS = r"[|\x{00bb}\x{203a}\x{2022}\x{00b7}>]"
NAVIGATION = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back|back to top|skip to content"
    r"|read more|more|share|print|contact|contact us|about|about us|site ?map|categories|tags|archive)[.:!]?[\x20\x09-\x0D]*\z"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright|privacy policy|terms of (use|service)|use of cookies|accept (all )?cookies"
    r"|enable javascript|lorem ipsum|subscribe to (our|the) newsletter|powered by [a-z]+|click here"
    r"|licensed under|released under the [a-z]+ license)"
)

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: What a text in lower case holds if ``BOILERPLATE`` is found in any of its lines: how each phrase starts.
BOILERPLATE_STARTS = (
    "all rights reserved", "copyright", "privacy policy", "terms of ", "use of cookies", "accept ", "enable javascript", "lorem ipsum",
    "subscribe to ", "powered by ", "click here", "licensed under", "released under the ",
)
#: Characters of the longest navigation phrase with its mark; white space around it does not count.
NAVIGATION_CHARS = len("skip to content") + 1
#: Percent of a line's words that may carry symbols, and words from which a line needs closing punctuation.
SYMBOL_PERCENT, OPEN_WORDS = 30, 4
#: Separators that make a line a list of links.
LINKS = 3
#: Percent of its word characters that a document may lose.
LOSS_PERCENT = 50


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NO_GAP))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, WORD_GAP, ""))


def may_hold_boilerplate(low: Column) -> Column:
    """Of a text in lower case: false only where no line has a boilerplate phrase."""
    out = F.lit(False)
    for start in BOILERPLATE_STARTS:
        out = out | F.contains(low, F.lit(start))
    return out


def line_fails(line: Column, suspect: Column | bool = True) -> dict[str, Column]:
    """For each rule, whether a line fails it, however long it is. Cheap tests
    come first: what follows ``&`` is only evaluated where they hold. ``suspect``:
    ``may_hold_boilerplate`` of the text."""
    suspect = F.lit(suspect) if isinstance(suspect, bool) else suspect
    marked = F.greatest(F.regexp_count(line, F.lit(MARKED)), F.regexp_count(line, F.lit(SHOUTS)))
    return {
        "punctuation": (line.rlike(f"{SYMBOLS}|{SHOUTS}") & (100 * marked > SYMBOL_PERCENT * n_words(line))) | (~line.rlike(TERMINAL) & (n_words(line) >= OPEN_WORDS)),
        "navigation": (F.regexp_count(line, F.lit(SEPARATORS)) >= LINKS) | ((F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) <= NAVIGATION_CHARS) & line.rlike(NAVIGATION)),
        "boilerplate": suspect & line.rlike(BOILERPLATE),
    }


def _tail(a: Column, skip: int) -> Column:
    return F.slice(a, F.lit(skip + 1), F.greatest(F.size(a) - skip, F.lit(0)))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the lines and word
    characters lost, and the cleaned text, for each row of ``docs``."""
    null_free = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", null_free.alias("text"))
    df = df.select("*", F.array_remove(F.split("text", WORD_GAP), "").alias("_w"), F.split("text", "\n").alias("_lines"))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    pair = F.zip_with("_h", _tail(F.col("_h"), 1), lambda a, b: F.xxhash64(a, b))
    triple = F.zip_with(pair, _tail(F.col("_h"), 2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_g", F.slice(triple, F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))))
    # Windows found twice: sorted with their places, equal neighbours stand together.
    placed = F.array_sort(F.zip_with("_g", F.sequence(F.lit(1), F.size("_g")), lambda g, p: F.struct(g.alias("g"), p.alias("p"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed))
    twice = F.flatten(
        F.zip_with(
            "_s", _tail(F.col("_s"), 1),
            lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
        )
    )
    df = df.withColumn("_at", F.array_sort(F.array_distinct(twice)))
    # A repeated window covers three words, or fewer where the next one starts sooner.
    covered = F.aggregate(
        F.zip_with("_at", _tail(F.col("_at"), 1), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"), lambda total, n: total + n,
    )
    fails = lambda x, suspect: (lambda f: f["punctuation"] | f["navigation"] | f["boilerplate"])(line_fails(x, suspect))
    # Every line is judged once. Zipped, so that the text is not searched anew for each line.
    df = df.withColumn("_low", F.lower("text"))
    suspect = F.array_repeat(may_hold_boilerplate(F.col("_low")), F.size("_lines"))
    df = df.withColumn("_judged", F.zip_with("_lines", suspect, lambda x, s: F.struct(x.alias("line"), fails(x, s).alias("bad"))))
    lines = lambda bad: F.transform(F.filter("_judged", lambda j: j["bad"] == bad), lambda j: j["line"])
    df = df.select(
        "doc_id", "text",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter("_lines", lambda x: x.rlike(NO_GAP)).alias("_full"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        lines(True).alias("_bad"),
        lines(False).alias("_good"),  # pruned where the cleaned text is not asked for
    )
    df = df.select("*", F.array_join("_good", "\n").alias("clean_text"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    lost = word_chars(F.array_join("_bad", "\n")).cast("long")
    df = df.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", base_failed.alias("base_failed"),
        F.size("_bad").cast("long").alias("lines_lost"), lost.alias("chars_lost"), "clean_text",
    )
    kept = ~F.col("base_failed") & (100 * F.col("chars_lost") <= LOSS_PERCENT * F.col("word_chars"))
    return df.withColumn("kept", kept)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their failing lines removed; the same
    columns as ``docs``, with n_chars (if present) counted anew."""
    extra = F.struct(*[F.col(c) for c in docs.columns])
    verdict = judged(docs.select(F.struct(F.col("doc_id").alias("id"), extra.alias("row")).alias("doc_id"), "text"))
    # The row number keeps the filter above the projection: pushed below it, the
    # whole expression of ``kept`` would be written out again and again.
    verdict = verdict.withColumn("_row", F.monotonically_increasing_id())
    out = verdict.filter(F.col("kept") & (F.col("_row") >= 0)).select(
        *[
            (
                F.col("clean_text") if c == "text" else F.length("clean_text").cast("long") if c == "n_chars" else F.col("doc_id.row")[c]
            ).alias(c)
            for c in docs.columns
        ]
    )
    return out


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_lost", "chars_lost"]


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return judged(documents(spark, sf_dir)).select(*DIGEST)


def _duck(pattern: str) -> str:
    """The same pattern as a DuckDB string literal."""
    return "'" + pattern.replace("'", "''") + "'"


_COUNT = "len(regexp_extract_all(line, {}))"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, {_duck(NO_GAP)}) AS w FROM d)),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
cnt AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, {_duck(NO_GAP)}) GROUP BY r),
bad AS (
  SELECT r, count(*) AS lines_lost, sum(length(regexp_replace(line, {_duck(WORD_GAP)}, '', 'g'))) AS chars_lost FROM ln
  WHERE 100 * greatest({_COUNT.format(_duck(MARKED))}, {_COUNT.format(_duck(SHOUTS))}) > {SYMBOL_PERCENT} * {_COUNT.format(_duck(NO_GAP))}
     OR ({_COUNT.format(_duck(NO_GAP))} >= {OPEN_WORDS} AND NOT regexp_matches(line, {_duck(TERMINAL)}))
     OR {_COUNT.format(_duck(SEPARATORS))} >= {LINKS} OR regexp_matches(line, {_duck(NAVIGATION)})
     OR regexp_matches(line, {_duck(BOILERPLATE)})
  GROUP BY r),
s AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, {_duck(SYMBOLS + "+")}, '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lines_lost, 0) AS lines_lost, CAST(coalesce(chars_lost, 0) AS BIGINT) AS chars_lost
  FROM d LEFT JOIN cnt USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN bad USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND 100 * chars_lost <= {LOSS_PERCENT} * word_chars AS kept FROM b
"""
