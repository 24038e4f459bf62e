import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"


@pytest.mark.parametrize("gone", [["corpus_pipeline.py", "lumenframe/llm"], ["lumenframe/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "lumenframe"):
        src = HERE / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name)
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    for name in gone:
        p = tmp_path / name
        shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, check=False)
    n, has, sub = done.stdout.split()
    assert (int(n) > 60, has, sub) == (True, "False", "True"), done.stderr
