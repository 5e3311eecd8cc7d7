"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra and clashing columns."""

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "",
    None,
    "   \n\t  ",
    "\nOne line\nOne line\n\nañb — 世界 😀 ﬁ it's 12.50 <|endoftext|> x y\x1cz\r\nend",
    "x" * 5000,
    "word " * 3000,
    "a b c d e f g h a b c d e f g h a b c d e f g h tail",
    "The quick brown fox jumps over the lazy cat near the river bank today.",
]
ROWS = [(i * 7, text, "en" if i % 2 else None, f"src{i % 3}", len(text or "")) for i, text in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Includes a repeated row, a tie of doc_id and a null doc_id."""
    rows = [*ROWS, ROWS[0], (7, "another text with the id 7", "fr", None, 1), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def crowded(docs, *names):
    """Extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("z").alias(n) for n in names))
