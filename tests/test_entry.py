import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from nearfield import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["knn_l2_exact", "knn_cosine_exact", "knn_unnormalized_ip", "knn_filtered_label", "range_search", "quantize_codes", "ivf_search_label_centroids", "lloyd_one_step", "latency_iqr_mean", "dim_split", "index_exhaustive_f32", "knn_after_append"]


def rounded(rows):
    return sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_sql(spark, data, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    want = c.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rounded(map(tuple, got.select(*want.columns).collect())) == rounded(want.fetchall())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_data_operators():
    code = "import sys, importlib.abc\n" "class No(importlib.abc.MetaPathFinder):\n" "    def find_spec(self, name, path=None, target=None):\n" "        if name in ('nearfield.llm', 'corpus_pipeline'):\n" "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n" "sys.meta_path.insert(0, No())\n" "import __spark_entry__ as e\n" "assert 'knn_l2_exact' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
