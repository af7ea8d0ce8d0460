"""The library without its optional subpackage, and the folder for intermediate tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from sigloom import session

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    """Both folders gone, with and without the pipeline's file: everything else still imports and registers."""
    for name in ("sigloom", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", "bench.py"] + ["corpus_pipeline.py"] * pipeline:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import bench, tests.oracle, __spark_entry__ as e; from sigloom import catalog; assert set(e.queries()) == set(catalog.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(spark)


def test_shared_tables_are_deleted(spark):
    path = session.saved(spark.range(3), "gone")
    assert Path(path.removeprefix("file://")).exists()
    assert session.clear() >= 1 and not Path(path.removeprefix("file://")).exists()
    assert session.clear() == 0
