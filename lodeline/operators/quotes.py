"""Which quotes appear in which texts, for whole tables of both.

A quote appears if the text has it as it is, or at least 85 % of its longer words. So
of its m longer words at most ⌊0.15 m⌋ may be missing, and of any ⌊0.15 m⌋ + k at least
k are there: the rarest ones are looked for, and counted by text. A word that a text has lies inside one of the
text's tokens, so words meet the vocabulary by their rarest three letters, tokens lead to
texts, and only what is left is confirmed on whole texts. Quotes without longer words are
met by three characters of their own. All steps are equi-joins.

Defined results: quotes of under 8 characters and null ones appear nowhere; a null text
is empty. Ids are taken to be unique. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .staging import stored

#: Characters that words and tokens meet by; percent of a quote's longer words that may be missing; words beyond these that are looked for.
GRAM, MISSING, MORE = 3, 15, 6


def grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - GRAM + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(GRAM))))


def rare_words(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, word, gram, times, least): of each quote so many of its rarest
    longer words that a text which has the quote has ``least`` of their ``times``,
    one at least, and what each is met by. ``counts``: gram, n."""
    words = items.select("item_id", F.size("q.words").alias("m"), F.explode("q.words").alias("word")).groupBy("item_id", "m", "word").agg(F.count(F.lit(1)).alias("times"))
    met = words.select("word").distinct().select("word", F.explode(grams(F.col("word"))).alias("gram")).join(counts, "gram", "left")
    best = met.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("b")).select("word", "b.*")
    order = Window.partitionBy("item_id").orderBy("n", "word").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("times").over(order), F.lit(0))
    missing = F.floor(F.col("m") * MISSING / 100)
    picked = words.join(best, "word").withColumn("before", before).filter(F.col("before") < missing + MORE)
    return picked.withColumn("least", F.sum("times").over(Window.partitionBy("item_id")) - missing).select("item_id", "word", "gram", "times", "least")


def appearing(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id, whole) of quotes (item_id, quote) that appear in texts
    (doc_id, text); ``whole``: as they are."""
    docs = stored(texts.select("doc_id", T.normalize(F.col("text")).alias("t")), "normal-texts")
    items = stored(quotes.select("item_id", T.quote_parts(F.col("quote")).alias("q")).filter(F.length("q.quote") >= 8), "quotes")
    tokens = stored(docs.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("token")).filter(F.length("token") >= GRAM), "text-tokens")
    asked = items.select(F.explode("q.words").alias("word")).distinct().select(F.explode(grams(F.col("word"))).alias("gram")).distinct()
    vocabulary = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    met = stored(vocabulary.select("token", "n", F.explode(grams(F.col("token"))).alias("gram")).join(asked, "gram", "left_semi"), "met-tokens")
    picked = stored(rare_words(items, met.groupBy("gram").agg(F.sum("n").alias("n"))), "rare-words")
    inside = picked.select("word", "gram").distinct().join(met, "gram").filter(F.contains("token", "word")).select("word", "token")
    here = picked.join(inside, "word").select("item_id", "word", "times", "least", "token").join(tokens, "token")
    once = here.groupBy("item_id", "doc_id", "word").agg(F.first("times").alias("times"), F.first("least").alias("least"))
    pairs = once.groupBy("item_id", "doc_id").agg(F.sum("times").alias("there"), F.first("least").alias("least")).filter(F.col("there") >= F.col("least")).select("item_id", "doc_id")
    bare = items.filter(F.size("q.words") == 0)
    if not bare.isEmpty():
        first = bare.select("item_id", F.substr("q.quote", F.lit(1), F.lit(GRAM)).alias("gram"))
        pairs = pairs.unionByName(docs.select("doc_id", F.explode(grams(F.col("t"))).alias("gram")).join(first, "gram").select("item_id", "doc_id"))
    found = stored(pairs.distinct(), "quote-pairs").join(items, "item_id").join(docs, "doc_id")
    return found.filter(T.parts_appear(F.col("q"), F.col("t"))).select("item_id", "doc_id", F.contains("t", F.col("q.quote")).alias("whole"))
