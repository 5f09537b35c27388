import random

import duckdb
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text[, source[, lang]]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and long texts, ties and repeated rows, and columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "the same words in this text again"), (3, "the same words in this text again"), (None, "no id at all here"), (None, None), (4, "x" * 70_000), (5, "\n \t"), (6, "…!?"), (7, "the same words in this text again"), (3, "another text of a shared id")]
    made = docs(rows)
    for c in ("rep", "node", "size", "count", "label", "score", "term", "_range", "_rn", "_key", "_source", "sequence_id", "length", "kind", "side", "_text", "_hash", "_tokens", "_copy", "copy", "block", "_j", "_m", "at", "goal", "weight", "vec", "same", "marked", "base", "added", "lang_pred", "_row", "_n"):
        made = made.withColumn(c, F.lit(c))
    return made


@pytest.fixture(scope="session")
def words():
    """Texts of invented words."""

    def make(seed, n):
        dice = random.Random(seed)
        return " ".join("".join(dice.choice("abcdefghij") for _ in range(dice.randint(2, 7))) for _ in range(n))

    return make


@pytest.fixture()
def duck_of():
    """DuckDB with one table made of a frame's rows."""

    def make(df, name="documents"):
        con = duckdb.connect()
        table = df.toArrow()
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        return con

    return make
