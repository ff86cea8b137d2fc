import shutil

import duckdb
import pytest

from skerry import registry
from tests.oracle import DATA, compare, rows_of


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_point_imports_and_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["s_walk", "t_scores"])
def test_tables_in_many_files_give_the_same_rows(spark, tmp_path, name):
    """Tables that are folders of part files, as larger ones are, beside some of one file."""
    for p in DATA.glob("*.parquet"):
        if p.stem in ("documents", "pages"):
            spark.read.parquet(str(p)).repartition(3).write.parquet(str(tmp_path / p.name))
        else:
            shutil.copy(p, tmp_path / p.name)
    sql = registry.ORACLES[name].replace("FROM documents", f"FROM '{DATA}/documents.parquet'")
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(duckdb.sql(sql).df())
