from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names operators use inside."""

    def make(rows, extra: bool = True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "rank", "part", "fp", "digest", "key", "__hash", "__size", "node", "component_id", "score", "x", "y", "shard", "bin", "length", "_metadata", "file", "row", "keep", "kept", "copies"):
                df = df.withColumn(name, F.lit("extra"))
        return df

    return make


@pytest.fixture
def words():
    import random

    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(3000)]

    def text(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    return text


@pytest.fixture
def sql_rows():
    """Rows of an oracle on the smallest tables, as sorted text."""
    import duckdb

    def rows(name, oracles):
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        return sorted(map(repr, c.sql(oracles[name]).fetchall()))

    return rows
