"""Every query of the training-data problems on tables with nulls in any column, and on empty ones."""

import pytest
from pyspark.sql import functions as F

from terrane import queries as core
from terrane.llm import queries as llm

TABLES = ("files", "chunks", "concepts", "concept_occurrences", "file_embeddings", "search_hits", "index_state", "scan_runs", "documents", "eval_items")
UNIQUE = {"documents": "doc_id", "eval_items": "item_id"}
QUERIES = {n: f for n, f in (core.queries() | llm.queries()).items() if n.startswith("p") and n[1].isdigit()}


@pytest.fixture(scope="module")
def dirty(spark, sf, tmp_path_factory):
    """A third of the rows with a null in a column each time, some rows twice, and columns that clash with results."""
    folder = tmp_path_factory.mktemp("dirty")
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet").limit(400)
        for i, c in enumerate(df.columns):
            if c != UNIQUE.get(t):
                df = df.withColumn(c, F.when(F.abs(F.xxhash64(*df.columns, F.lit(i))) % 8 != 0, F.col(c)))
        if t not in UNIQUE:
            df = df.unionByName(df.limit(40))
        for clash in ("place", "kind", "boundary", "n", "origin", "segment", "value", "model", "id", "rank", "ids", "percentile"):
            if clash not in df.columns:
                df = df.withColumn(clash, F.lit("clash"))
        df.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_anywhere(spark, dirty, name):
    rows = QUERIES[name](spark, dirty).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
