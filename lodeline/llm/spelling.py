"""Grouping of spelling variants: words that differ by one letter, and the more
frequent form that a word goes back to.

A word of L letters with a terminator has L + 1 rotations. Of a rotation that ends
in a letter, the prefix without that letter is the word with one letter skipped.
Words that differ by a replaced letter share such a prefix; a word is, as a whole
rotation, the prefix of any word with one letter more. So in the order of all
rotations near words stand in one range: the rotation itself, then those that go on
by one letter. A range has no more members than the alphabet has letters (90), and
one, so ranges are small whatever the words; each is scanned once, and what leaves
it is one row for a member (how many near words it has here and the best of them),
never a pair. Where equal letters follow each other, leaving out any of them gives
the same word; only the first counts.

A form has twice its word's count at least, so chains of forms are no longer than
the logarithm of the greatest count, and following them by doubling steps takes the
logarithm of that.

Defined results: a null or empty text has no runs. A null doc_id is written as
nothing. Repeated rows count each time. Of near words with equal counts the first in
code-point order is the form. An empty table gives none, and other columns are
ignored, whatever their names. A very long run is a word like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crc
from .common import documents, stored

RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points and occurrences of a word at least; how many times as frequent a form is.
LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
#: Of so many hash values one marks a run whose letter is left out.
EVERY = 97
END = "$"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): frequent words of docs (doc_id, text)."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_CHARS)
    low = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _UPPER.lower())).otherwise(F.col("run")).alias("w"))
    hashed = low.select("w", F.crc32(F.concat("id", F.lit(":"), "w")).alias("h"))
    at = F.pmod(F.col("h"), F.length("w")).cast("int")
    cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
    result = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("w")).alias("word")).filter(F.length("word") >= LEAST_CHARS)
    return result.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def rotations(counted: DataFrame) -> DataFrame:
    """(range, letter, n) of words: each rotation as its own range with no letter,
    and, where it ends in a letter, its prefix with that letter."""
    turn = counted.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("j"))
    skips = F.array(F.lit(0), F.lit(1))
    turned = turn.select("n", "j", F.concat(F.substr("word", F.col("j") + 1), F.lit(END), F.substr("word", F.lit(1), F.col("j"))).alias("r"), F.explode(F.when(F.col("j") > 0, skips).otherwise(F.array(F.lit(0)))).alias("skip"))
    size = F.length("r") - F.col("skip")
    return turned.select(F.substr("r", F.lit(1), size).alias("range"), F.substr("r", size + 1).alias("letter"), "n")


def neighbours(counted: DataFrame) -> DataFrame:
    """(word, n_near, best): of each word with near ones their number, and the
    most frequent of them as (-n, word)."""
    r = rotations(counted)
    # The word is in the range: what follows the terminator, the letter, and what comes before.
    word = F.concat(F.substring_index("range", END, -1), "letter", F.substring_index("range", END, 1))
    whole = F.col("letter") == ""
    # Leaving out this letter is not the same as leaving out the one before.
    first = ~whole & (F.col("letter") != F.right(F.col("range"), F.lit(1)))
    r = r.select("range", "letter", "n", whole.alias("whole"), first.alias("first"), F.struct((-F.col("n")).alias("less"), word.alias("word")).alias("me"))
    here = Window.partitionBy("range")
    order = here.orderBy("whole", "me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = r.select(
        "whole", "first", "me",
        F.sum(F.when(~F.col("whole"), 1).otherwise(0)).over(order).alias("skips"),
        F.sum(F.when(F.col("first"), 1).otherwise(0)).over(order).alias("firsts"),
        F.max(F.when(F.col("whole"), F.col("me"))).over(order).alias("whole_one"),
        F.min(F.when(F.col("first"), F.col("me"))).over(order).alias("best_first"),
        F.first(F.when(~F.col("whole"), F.col("me"))).over(order).alias("best_skip"),
        F.nth_value(F.when(~F.col("whole"), F.col("me")), 2).over(order).alias("next_skip"),
    )
    other = F.when(F.col("best_skip") == F.col("me"), F.col("next_skip")).otherwise(F.col("best_skip"))
    longer = F.when(F.col("first"), F.col("whole_one"))
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("skips") - 1 + F.when(longer.isNotNull(), 1).otherwise(0))
    best = F.when(F.col("whole"), F.col("best_first")).otherwise(F.least(other, longer))
    found = seen.select("me.word", near.cast("long").alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each chain. Every round
    doubles what a step spans."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("onward")), "root", "left")
        nxt = stored(on.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        at = nxt.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word."""
    counted = stored(words(docs), "words")
    near = stored(neighbours(counted), "near-words")
    told = counted.join(near, "word", "left")
    fits = -F.col("best.less") >= TIMES * F.col("n")
    told = stored(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms-told")
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


ORACLE_SQL = f"""WITH RECURSIVE {crc.TABLE_SQL},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_UPPER.lower()}') AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= {LEAST_CHARS} GROUP BY ALL),
h AS (SELECT w, n, {crc.sql("(doc_id || ':' || w)")} AS h FROM u, crc_t),
v AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
c AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= {LEAST_CHARS} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM c),
k AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || '$' || substr(word, (i + 1)::INT) AS replaced, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS shorter FROM x),
p AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM k a JOIN k b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT k.word, c.word, c.n FROM k JOIN c ON k.shorter = c.word
  UNION SELECT c.word, k.word, k.n FROM k JOIN c ON k.shorter = c.word),
b AS (SELECT a AS word, count(*) AS n_near, max(n) AS best FROM p GROUP BY 1),
f AS (SELECT p.a AS word, min(p.b) AS form FROM p JOIN b ON b.word = p.a AND b.best = p.n JOIN c ON c.word = p.a WHERE p.n >= {TIMES} * c.n GROUP BY 1),
g AS (SELECT word, form AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at),
o AS (SELECT g.word, g.at AS root FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.word = g.at))
SELECT c.word, f.form, coalesce(o.root, c.word) AS root, c.n, coalesce(b.n_near, 0)::BIGINT AS n_near, d.n AS form_n
FROM c LEFT JOIN b USING (word) LEFT JOIN f USING (word) LEFT JOIN o USING (word) LEFT JOIN c d ON d.word = f.form"""
