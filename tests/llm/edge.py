"""Documents with everything that tends to break: nulls, empty and long texts, repeats, ties, clashing columns."""

LONG = "the quick brown fox jumps over the lazy dog. " * 4000
ROWS = [
    (1, "Hello world, this is a text.", "en", "a", 28),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r", "en", "b", 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, "Hello  world,\nthis is a text.", "en", "a", 29),
    (7, "é中\U0001f600 \u0000x ﻿ſ Σ <|turn|> \\", "xx", "c", 9),
    (7, "é中\U0001f600 \u0000x ﻿ſ Σ <|turn|> \\", "xx", "c", 9),
    (None, "Hello world, this is a text.", "en", "a", 28),
    (None, None, None, None, None),
    (8, "a b", "en", None, 3),
    (9, "HELLO WORLD, this is a text.", "en", "a", 28),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if not extra:
        return df
    from pyspark.sql import functions as F

    # Names that operators use themselves.
    for name in ("fp", "copy_no", "n_words", "score", "kept", "_dig", "path", "root", "_sha256", "_kept", "_SOURCE", "_rate", "_part", "_raws", "_map", "_id", "keep_id"):
        df = df.withColumn(name, F.lit("own"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
