"""The driver's contract."""

import os

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_the_training_operators():
    for folder, _, names in os.walk(f"{HERE}/quern"):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "quern.llm" not in f.read()


def test_missing_modules_of_the_training_operators_are_errors(tmp_path):
    """Only the subpackage itself (with corpus_pipeline) may be absent."""
    import shutil
    import subprocess
    import sys

    for name in ("quern", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(HERE, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    found = run()
    assert found.returncode == 0 and int(found.stdout) >= 70
    (tmp_path / "quern/llm").mkdir()
    (tmp_path / "quern/llm/__init__.py").write_text("")
    (tmp_path / "quern/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    found = run()
    assert found.returncode and "a_module_that_is_not_there" in found.stderr


def test_id_stats_grow_with_the_table(spark, tmp_path):
    """Ids outside 100 to 5000 and other statuses count as well."""
    from quern import queries

    rows = [(1, "O"), (100, "F"), (5000, "O"), (5001, "P"), (10**9, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in queries.QUERIES["a7_id_stats"](spark, str(tmp_path)).collect()] == [(1, 10**9, 5)]
