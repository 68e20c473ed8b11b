"""Operators whose workers can't import the package."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_need_no_package(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
        def importable(batches):
            import importlib.util
            import pandas as pd
            for _ in batches:
                yield pd.DataFrame({{"x": [importlib.util.find_spec("brindle") is not None]}})
        assert not any(r.x for r in spark.range(2).mapInPandas(importable, "x boolean").collect())
        from brindle.llm import queries
        for name, query in queries.QUERIES.items():
            print(name, query(spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) == 20
