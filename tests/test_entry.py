import os
import shutil
import subprocess
import sys

import __spark_entry__ as registry

ROOT = os.path.dirname(os.path.abspath(registry.__file__))


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_runs(spark):
    assert registry.entry(spark).count() > 0


def test_imports_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/fathomix", tmp_path / "fathomix", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_part():
    for folder, _, names in os.walk(f"{ROOT}/fathomix"):
        if os.path.basename(folder) == "llm":
            continue
        for n in (x for x in names if x.endswith(".py")):
            with open(f"{folder}/{n}", encoding="utf-8") as f:
                assert "llm" not in f.read(), n
