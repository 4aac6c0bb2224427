import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).columns == ["seq_id", "motif_id", "bc"]


def test_a_broken_installation_is_an_error(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "strandlake"), tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "strandlake" / "llm").mkdir()
    (tmp_path / "strandlake" / "llm" / "queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr


def test_the_library_stands_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "strandlake"), tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, some = run.stdout.split()
    assert int(n) > 100 and some == "False"
