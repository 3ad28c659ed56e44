"""The driver's entry point in a fresh process, without a session, PySpark taken from its zip as under spark-submit."""

import subprocess
import sys
import zipfile
from pathlib import Path

import py4j
import pyspark
import pytest

REPO = Path(__file__).resolve().parents[1]


def _zip_of(package: Path, target: Path) -> Path:
    with zipfile.ZipFile(target, "w") as z:
        for p in [*package.rglob("*.py"), *package.rglob("*.json")]:
            z.write(p, p.relative_to(package.parent))
    return target


def test_queries_are_listed_without_a_session(tmp_path):
    zips = [_zip_of(Path(m.__file__).parent, tmp_path / f"{m.__name__}.zip") for m in (pyspark, py4j)]
    code = (
        f"import sys; sys.path[:0] = {[*map(str, zips), str(REPO)]!r}\n"
        "import pyspark; assert '.zip' in pyspark.__file__\n"
        "import __spark_entry__ as e\n"
        "assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 75\n"
        "from pyspark import SparkContext; assert SparkContext._active_spark_context is None\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


@pytest.mark.parametrize("library", ["tokenizers", "zstandard", "public_tokenizers"])
def test_a_missing_library_of_the_training_data_operators_takes_only_these(tmp_path, library):
    code = (
        f"import sys; sys.path.insert(0, {str(REPO)!r}); sys.modules[{library!r}] = None\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) >= 75 and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
