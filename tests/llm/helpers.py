"""Small frames with every awkward case: nulls in all columns, empty and long texts, ties, repeated rows, clashing
extra columns."""
from __future__ import annotations

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, words_ string, fp string, h string, "
          "mix string, size int, score double, component_id long")


def awkward(spark, texts=None):
    """Documents whose extra columns bear names that operators use."""
    base = texts or ["one two three four five six seven eight nine ten " * 5, "", None, "   \n\t ", "x",
                     "Call +1 (974) 555-3436 or write to a.b@mail.example.com now please",
                     "lorem ipsum dolor sit amet " * 4000, "ÄÖÜ ñandú çà 你好 world", "x"]
    rows = [(i, t, "en" if i % 2 else None, ["a", None, "b"][i % 3], None if t is None else len(t), "w", "f", "h", "m",
             1, 0.5, 7) for i, t in enumerate(base)]
    rows += [rows[0], rows[0], (None, "one two", None, None, None, None, None, None, None, None, None, None),
             (4, "x", "en", "a", 1, "w", "f", "h", "m", 1, 0.5, 7)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
