import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["tokenize", "normalize_tokens", "ngram_segments", "vocab_regular", "predict_topn", "threshold_sweep", "fuzzy_match", "create_dataset"]


def canonical(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_statement(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    theirs = con.sql(entry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    assert canonical(df.select(*columns).collect()) == canonical(theirs.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    repo = Path(entry.__file__).resolve().parent
    copy = tmp_path / "copy"
    copy.mkdir()
    subprocess.run(["cp", "-r", str(repo / "ctxvote"), str(repo / "__spark_entry__.py"), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "ctxvote" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
