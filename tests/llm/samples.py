"""Small tables with the cases that every operator must bear."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of the input they must do no harm.
CLASHES = ("id", "text2", "size", "found", "sig", "label", "_k", "_t", "score", "key", "n", "code", "kinds", "taken")

LONG = " ".join(f"word{k % 977} and more" for k in range(6000))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "one two",
    "The river flows down to the sea and the rain falls on the hill again and again",
    "The river flows down to the sea and the rain falls on the hill again and again",
    "Ünïcode wörds — “quoted” 😀 text with odd blanks and\x85lines\r\nend",
    "!!! ??? 123 456",
    LONG,
    "a\x00b \x1c c <|endoftext|> d",
]


def docs(spark, texts=TEXTS, clash: bool = True) -> DataFrame:
    """A table of documents: rows 5 and 6 are equal texts; the last row repeats the first id; one id,
    one source and one language are null."""
    rows = [(k + 1, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], len(t) if t else None) for k, t in enumerate(texts)]
    rows.append((1, "a text of the same id", "en", "a", 21))
    rows.append((None, "a text without an id", "en", "a", 20))
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def write(spark, folder, **tables) -> str:
    """Tables as a query reads them."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, query, sql: str, sf: str = SF) -> int:
    """A query and its DuckDB twin give equal rows; gives their number."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        at = f"{sf}/{t}.parquet"
        if os.path.exists(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}{'/*.parquet' if os.path.isdir(at) else ''}')")
    order = lambda df: df[sorted(df.columns)].sort_values(sorted(df.columns), ignore_index=True)
    got, want = order(query(spark, sf).toPandas()), order(con.execute(sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-12)
    return len(got)
