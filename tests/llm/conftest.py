from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"

#: documents with columns whose names an operator might use itself
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("lang", "source")]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("label", "score", "kept", "fp", "root", "block", "data", "shard", "_text", "_t", "_score", "held_out", "n_words", "ids", "piece")]
)


def messy_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["the", "and", "wörd", "中文", "MIT", "License", "general", "public", "it's", "we'll", "1234", "x" * 30, "...", "😀", "<|endoftext|>", "<s>", "▁"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same, passage = prose(80), prose(40)
    near = same.split(" ")
    near[40] = "changed"
    return [
        None, "", " \n\t ", "a", "MIT License", "Licensed under the Apache License, Version 2.0.", "GNU GENERAL\nPUBLIC   LICENSE\x00general public license",
        same, same, " ".join(near), passage + " one " + prose(30), "two " + passage + prose(30), passage[:49], "é" * 60, "é" * 60 + "x", "x" * 50_000, "ab " * 20_000,
        "line one\nline one\n\nline two \nline two", "mit mit license license apache license mit license", prose(3000), "'s 're 'lla ''s  '   \x1c end ", "nul\x00nul",
    ]


def rows_of(texts, first=0):
    extra = ["clash"] * (len(SCHEMA) - 5)
    return [(first + i, t, "en", "src", len(t or ""), *extra) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def messy_rows():
    rows = rows_of(messy_texts())
    rows.append(rows[7])  # a repeated row
    rows.append((None, messy_texts()[7], None, None, None, *[None] * (len(SCHEMA) - 5)))  # no id
    rows.append((None, None, None, None, None, *[None] * (len(SCHEMA) - 5)))
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def key(r):
    return tuple((x is None, str(x)) for x in r)
