"""Documents that are dated after the time of a search or a batch: such tables are what sf0.1 is at five times its size."""

import os
import shutil

import pytest
from compare import of_duck, of_spark
from conftest import SF
from pyspark.sql import functions as F
from siltstone import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables with every third document (and its vector) moved two years ahead."""
    out = tmp_path_factory.mktemp("ahead")
    for name in os.listdir(SF):
        shutil.copyfile(f"{SF}/{name}", out / name)
    for name, key in (("documents", "doc_id"), ("embeddings", "vec_id")):
        moved = spark.read.parquet(f"{SF}/{name}.parquet").withColumn(key, F.when(F.col(key) % 3 == 1, F.col(key) + 20_000).otherwise(F.col(key)))
        os.remove(out / f"{name}.parquet")
        moved.write.parquet(str(out / f"{name}.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["source_weights", "hybrid_search", "engine_hybrid", "persisted_versions"])
def test_against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(folder):
        path = f"{folder}/{file}" + ("/*.parquet" if os.path.isdir(f"{folder}/{file}") else "")
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{path}')")
    assert of_spark(catalog.queries()[name](spark, folder)) == of_duck(con, catalog.oracle_sql()[name])
