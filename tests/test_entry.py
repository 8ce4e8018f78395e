"""The driver's contract holds with and without the optional parts."""

import subprocess
import sys
import textwrap

from tests.conftest import ROOT


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert e.entry(spark).count() > 0


def test_imports_without_the_optional_folders(tmp_path):
    code = textwrap.dedent(f"""
        import shutil, sys
        shutil.copytree({ROOT!r}, {str(tmp_path / 'r')!r}, ignore=shutil.ignore_patterns('.git', 'llm', 'corpus_pipeline.py', '__pycache__'))
        sys.path.insert(0, {str(tmp_path / 'r')!r})
        import __spark_entry__ as e
        q = e.queries()
        assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q), sorted(q)[:5]
        e.oracle_sql()
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        assert e.entry(spark).count() > 0 and q["a03_ast_group"](spark, "/root/testdata/sf0.001").count() > 0
        spark.stop()
    """)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_a_missing_library_takes_away_only_the_queries_that_need_it():
    code = textwrap.dedent(f"""
        import sys
        sys.modules["zstandard"] = None
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as e
        assert "a03_ast_group" in e.queries() and "a03_ast_group" in e.oracle_sql()
    """)
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True)
