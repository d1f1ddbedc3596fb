import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["qid", "unit_id", "score", "rank"] and out.count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env).returncode == 0


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(os.path.join(ROOT, "loomwork")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "loomwork.llm" not in open(os.path.join(folder, n)).read(), n
