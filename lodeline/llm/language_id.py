"""Language identification by Bayesian fusion of evidence.

Text gives likelihoods: byte trigrams of the whole text, hashed, under a table
for each language. The table is fitted on a bounded sample of labelled rows
(``TRAIN_ROWS``, those of least id hash). To these are added, as logarithms, what
a declared markup language and an address suffix say (how often each goes with
a language, by what texts alone tell over all rows) and the host's prior. Host
priors are smoothed towards the parent domain's and those towards all rows',
from counts made by grouped aggregation over all rows.

A document is rejected if it has no letters, or no language reaches
``MIN_POSTERIOR``.

Defined results: a null or empty text, or one without letters, has no language
(null), confidence 0 and is rejected; missing host, suffix or declaration add
nothing; equal rows are judged alike; of equally probable languages the first by
name is taken. A very long text counts whole. An empty table gives none. Further columns
are ignored, except by ``accepted``, which returns them.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, documents, row_key, slices, stored

BUCKETS = 1 << 15
TRAIN_ROWS = 4000
#: Neighbouring trigrams say much the same, so n of them weigh as ENOUGH * n / (ENOUGH + n) independent ones; weight of the parent in a prior; least posterior.
ENOUGH, PRIOR_ROWS, MIN_POSTERIOR = 60, 20, 0.5

#: Numbers (a host, suffix or declaration times the languages) up to which a counted table of evidence is broadcast.
BROADCAST_NUMBERS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams that touch a letter, and for each text how many
    there are in it and all before."""
    buf = np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)
    low = _LOWER[buf]
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    use = _LETTER[buf[1:-1]]
    hashed = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    ends = np.cumsum([len(t) + 2 for t in texts])
    upto = np.concatenate(([0], np.cumsum(use)))[np.minimum(ends, len(use))]
    return hashed[use], upto


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]


def _counts(languages: list[str]):
    schema = pa.schema([("language", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in slices(batches, "text"):
            found, upto = trigrams(_raw(batch))
            a = 0
            for language, b in zip(batch.column(1).to_pylist(), upto.tolist()):
                total[index[language]] += np.bincount(found[a:b], minlength=BUCKETS)
                a = b
        rows, cols = np.nonzero(total)
        yield batch_of(schema, {"language": rows.astype(np.int32), "bucket": cols.astype(np.int32), "n": total[rows, cols]})

    return run


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, last: int | None = None):
        self.languages, self.table = languages, table  # log probabilities, language by bucket
        self.last = last  # the greatest id hash of the rows that the table was fitted on

    def fitted_on(self, doc_id: Column) -> Column:
        return F.lit(False) if self.last is None else F.xxhash64(doc_id) <= F.lit(self.last)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From (doc_id, text, language), by the ``rows`` rows of least id hash."""
    known = labelled.filter("language IS NOT NULL AND text IS NOT NULL")
    order = F.xxhash64("doc_id")
    chosen = known.select(order.alias("h"), "language").orderBy("h").limit(rows)
    found = chosen.agg(F.max("h").alias("most"), F.collect_set("language").alias("l")).first()
    languages = sorted(found["l"] or [])  # all of the sample, which bounds their number
    table = np.zeros((len(languages), BUCKETS))
    if languages:
        sample = known.filter((order <= F.lit(found["most"])) & F.col("language").isin(languages)).select("text", "language")
        for r in sample.mapInArrow(_counts(languages), "language int, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect():
            table[r.language, r.bucket] = r.n
    table += 0.1
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), found["most"])


def _scored(table: np.ndarray):
    schema = pa.schema([("n", pa.int64()), ("ll", pa.list_(pa.float64()))])

    def run(batches):
        for batch in slices(batches, "text"):
            found, upto = trigrams(_raw(batch))
            before = np.concatenate(([0], upto[:-1]))
            n = upto - before
            ll = np.zeros((len(n), len(table)))
            for k, row in enumerate(table):  # one language at a time: small arrays
                sums = np.concatenate(([0.0], np.cumsum(row[found], dtype=np.float64)))
                ll[:, k] = sums[upto] - sums[before]
            weight = (ENOUGH / (ENOUGH + n))
            ll = ll * weight[:, None]
            keep = [c for c in batch.schema.names if c != "text"]
            out = pa.schema([batch.schema.field(c) for c in keep] + list(schema))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(n, pa.int64()), pa.array(ll.tolist(), pa.list_(pa.float64()))], schema=out)

    return run


def parent_of(host: Column) -> Column:
    """The last two labels of a host's name."""
    return F.substring_index(host, ".", -2)


def _tally(languages: list[str]) -> Column:
    return F.array(*[F.sum((F.col("top") == i).cast("long")) for i in range(len(languages))])



def _counted(evidence: DataFrame, label: str, languages: int) -> DataFrame:
    """Stored and, if counted to be small, marked for broadcast: then a host
    with very many documents is no hot group. A larger one is joined by its
    key, and Spark splits skewed partitions of such joins."""
    evidence = stored(evidence, label)
    return F.broadcast(evidence) if evidence.count() * languages <= BROADCAST_NUMBERS else evidence


def identified(rows: DataFrame, model: Model, prior_rows: float = PRIOR_ROWS, least: float = MIN_POSTERIOR) -> DataFrame:
    """``rows``: doc_id, text, host, suffix, declared. Returns doc_id, rk (the
    text's hash), lang, text_lang, confidence and kept."""
    languages = model.languages
    base = rows.select("doc_id", row_key(F.col("text")).alias("rk"), "host", "suffix", "declared", "text")
    if not languages:
        none = F.lit(None).cast("string")
        return base.select("doc_id", "rk", none.alias("lang"), none.alias("text_lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("kept"))
    scored = base.mapInArrow(_scored(model.table), "doc_id bigint, rk bigint, host string, suffix string, declared string, n bigint, ll array<double>")
    top = F.when(F.col("n") > 0, F.array_position("ll", F.array_max("ll")) - 1)
    scored = stored(scored.withColumn("top", top), "language-scores")
    told = scored.filter("top IS NOT NULL")
    everywhere = (told.agg(_tally(languages).alias("c")).first()["c"]) or []
    everywhere = [float(x or 0) + 1.0 for x in (everywhere or [0] * len(languages))]
    overall = [x / sum(everywhere) for x in everywhere]
    flat = F.array(*[F.lit(x) for x in overall])
    size = F.array(*[F.lit(x) for x in everywhere])
    hosts = told.filter("host IS NOT NULL").groupBy("host").agg(_tally(languages).alias("counts"))
    parents = hosts.groupBy(parent_of(F.col("host")).alias("parent")).agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(len(languages))]).alias("counts"))
    prior = lambda counts, above: F.zip_with(
        counts, above, lambda n, p: n + prior_rows * p
    )
    share = lambda weights: F.transform(F.arrays_zip(weights.alias("w"), F.array_repeat(F.aggregate(weights, F.lit(0.0), lambda a, b: a + b), len(languages)).alias("t")), lambda x: x["w"] / x["t"])
    parents = parents.select("parent", prior(F.col("counts"), flat).alias("weights")).select("parent", share(F.col("weights")).alias("above"))
    hosts = hosts.withColumn("parent", parent_of(F.col("host"))).join(parents, "parent")
    hosts = hosts.select("host", prior(F.col("counts"), F.col("above")).alias("weights")).select("host", share(F.col("weights")).alias("host_prior"))
    signal = lambda c: told.filter(F.col(c).isNotNull()).groupBy(c).agg(_tally(languages).alias("counts")).select(
        c, F.zip_with("counts", size, lambda n, t: F.log((n + 0.5) / (t + 1.0))).alias(f"{c}_log")
    )
    joined = scored
    for c, evidence in (("host", hosts), ("suffix", signal("suffix")), ("declared", signal("declared"))):
        joined = joined.join(_counted(evidence, f"language-{c}", len(languages)), c, "left")
    zero = F.array(*[F.lit(0.0)] * len(languages))
    total = F.zip_with("ll", F.transform(F.coalesce("host_prior", flat), lambda p: F.log(p)), lambda a, b: a + b)
    for c in ("suffix_log", "declared_log"):
        total = F.zip_with(total, F.coalesce(c, zero), lambda a, b: a + b)
    fused = joined.select("doc_id", "rk", "n", "top", total.alias("total"))
    fused = fused.select("*", F.array_max("total").alias("most"), F.array_position("total", F.array_max("total")).cast("int").alias("best"))
    spread = F.zip_with("total", F.array_repeat("most", len(languages)), lambda a, m: F.exp(a - m))
    fused = fused.select("*", (1.0 / F.aggregate(spread, F.lit(0.0), lambda a, b: a + b)).alias("posterior"))
    names = F.array(*[F.lit(x) for x in languages])
    has = F.col("n") > 0
    return fused.select(
        "doc_id", "rk", F.when(has, F.element_at(names, F.col("best"))).alias("lang"), F.when(has, F.element_at(names, (F.col("top") + 1).cast("int"))).alias("text_lang"),
        F.when(has, F.col("posterior")).otherwise(0.0).alias("confidence"), (has & (F.col("posterior") >= least)).alias("kept"),
    )


def of_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The evidence in documents: source stands for the host, lang for the
    declaration. A row whose lang was the table's label declares nothing, so
    that a label does not count twice."""
    nothing = F.lit(None).cast("string")
    declared = F.when(~model.fitted_on(F.col("doc_id")), F.col("lang"))
    return docs.select("doc_id", "text", F.col("source").alias("host"), nothing.alias("suffix"), declared.alias("declared"))


def of_pages(pages: DataFrame) -> DataFrame:
    """The evidence in raw web pages."""
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z]+;", " ")
    return pages.select(F.col("page_id").alias("doc_id"), bare.alias("text"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), declared.alias("declared"))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language is told, with the language found in ``lang``."""
    model = model or fit(docs.select("doc_id", "text", F.col("lang").alias("language")))
    found = identified(of_documents(docs, model), model).filter("kept").select(F.col("doc_id").alias("_id"), F.col("rk").alias("_rk"), F.col("lang").alias("_lang")).dropDuplicates(["_id", "_rk"])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("_id")) & (row_key(docs["text"]) == F.col("_rk")))
    return joined.select(*[F.col("_lang").alias("lang") if c == "lang" else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", F.col("lang").alias("language")))
    return identified(of_documents(docs, model), model).drop("rk")


def pages_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.select("doc_id", "text", F.col("lang").alias("language")))
    return identified(of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), model).select(F.col("doc_id").alias("page_id"), "lang", "text_lang", "confidence", "kept")
