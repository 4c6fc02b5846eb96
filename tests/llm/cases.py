"""Small inputs that several operators' tests share."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "\n\n a", "a \n b", "a\n \nb", "don't stop, we'll see", "x y", "café naïve ßß",
    "é ́x", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>\n", "<|endof", "1234 5,678.90", "你好 世界", "\U0001f600\U0001f600 ok",
    "tab\tand\x0bvt\x0cff\rcr", "A" * 300, "ab" * 200 + " " + "!" * 50, " x\u0085y", "I'm 'tis 'LL", "a'  's", "\x1c\x1f z", "aaa aaaa aaaaa", "İstanbul ΣΑΣ ǅ Ĳ ſ ŉ ÀÉ",
]


def rows(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def clashing(df):
    """The table with more columns, whose names operators may use inside."""
    out = df
    for name in ("group", "part", "rk", "h", "kept", "n_tokens", "line", "_w", "score", "component_id", "position"):
        out = out.withColumn(name, F.lit("extra"))
    return out


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))
