"""Rows that every operator must stand: nulls, empty and very long texts, ties, clashing column names."""

from pyspark.sql import Row

LONG = "the quick brown fox jumps over the lazy dog and runs " * 4_000

TEXTS = [
    (1, "The cat sat on the mat, and the dog lay in the sun all day."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "  two  spaces\tand\n\nlines  é́ßİΣς日本語 🙂 <|endoftext|> x<|startoftext|>y  "),
    (6, "The cat sat on the mat, and the dog lay in the sun all day."),
    (6, "The cat sat on the mat, and the dog lay in the sun all day."),
    (7, "one"),
    (8, "\x1c\x1d \x85 \x00\x01"),
    (None, "a row without an id, and the text of it is not very long"),
    (None, None),
    (9, "word " * 30 + "\nsame line\nsame line\nsame line"),
    (10, "aaaa aaaaaaa abababab aaaaaaaaaaaaaaaaa"),
]

EXTRA = {"start": "x", "length": -1, "score": "s", "ids": None, "sequence_id": 5, "kept": "k", "n_words": 3, "fp": 1, "first": "f"}


def documents(spark, rows=None):
    rows = TEXTS if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string, length int, score string, ids string, sequence_id int, kept string, n_words int, fp int, first string"
    return spark.createDataFrame([Row(i, t, "en", None, None if t is None else len(t), *EXTRA.values()) for i, t in rows], schema)
