"""Small frames with every odd case, and brute-force references."""

from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 20_000
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType())])
CLASHING = ["kept", "keep_id", "_key", "_row", "row_key", "sha256", "score", "held_out", "predicted", "fp", "fingerprint", "component_id", "root",
            "node", "start", "length", "n_tokens", "ids", "toxic", "host", "html", "u", "v"]


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a"), (2, "alpha  beta gamma\tdelta epsilon", "en", "b"), (3, "alphabetagammadeltaepsilon", None, None),
            (4, None, "en", "a"), (5, "", "de", None), (6, " \n\t ", "de", "a"), (7, LONG, "en", "a"), (8, LONG + "x", "en", "a"),
            (9, "same words here", "en", "a"), (9, "same words here", "en", "a"), (9, "same words here", "en", "a"), (None, "same words here", "en", "a"),
            (None, "no id at all", "en", "a"), (None, None, None, None), (10, "ünïcödé 日本語 😀", "ja", "b"), (11, "a", "en", "b"), (12, "A", "en", "b")]
    return with_clashes(spark.createDataFrame(rows, DOCS))


def with_clashes(df):
    from pyspark.sql import functions as F
    for i, c in enumerate(CLASHING):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(f"x{i}"))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def union_find(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return find
