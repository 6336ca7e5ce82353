"""The driver's entry points, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_training_data_part(tmp_path):
    for p in ("lumenframe", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), tmp_path], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lumenframe/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.oracle_sql() if k[2:3].isdigit()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/root"}, capture_output=True, text=True)
    assert out.stdout.split()[1:] == ["False"], out.stderr
