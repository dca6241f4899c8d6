"""Small tables and brute-force pieces for the operator tests."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=3):
    """rows: (doc_id, text[, source[, lang]])"""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)


def stored(spark, tmp_path, rows):
    """The folder of a small documents table, for a query."""
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


#: null, empty, blank, short, non-Latin, astral, repeated rows, a long text
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six seven\neight"),
       (6, "漢字 かな 🎉🎉 é \x0b b c"), (7, "a b c d e " * 40), (7, "a b c d e " * 40), (None, "no id here at all"),
       (9, "same same same same same same same same"), (10, ("w%d " * 3000) % tuple(range(3000))), (11, "x" * 5000)]
