"""Small tables and plain brute-force versions for the tests of the training-data operators."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
TINY = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that the operators use inside, as further columns of an input.
CLASHING = ["_id", "_text", "key", "n", "id", "start", "end", "bits", "node", "w0", "row", "spans", "lang_", "ids",
            "score", "rule", "host", "path", "verdict", "label", "batch", "_batch", "of", "a", "b", "first"]

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
PLAIN = "The committee met on the second day and wrote a long report about rivers, bridges and the people by them."


def odd_rows() -> list[tuple]:
    """Null, empty, white, short, long, tied and repeated rows."""
    rows = [
        (1, PLAIN, "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"), (5, "one", "xx"), (None, "no id here", "en"),
        (6, LONG, "en"), (7, PLAIN, "en"), (7, PLAIN, "en"), (8, "a\x00b \U0001f600 é́ <|endoftext|>", "fr"),
        (9, PLAIN.upper(), None), (10, "# $ % " * 30, "de"), (11, "same same same same same same same same", "en"),
    ]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), TINY)


def clashing(docs):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def small(spark, name: str = "documents"):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
