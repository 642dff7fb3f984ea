"""Operators that store something work in a local session whose settings name no shared folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
from pyspark.sql import SparkSession
from tidemark.llm import mixing, queries, secrets

spark = SparkSession.builder.master("{master}").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
print(len(mixing.mix(docs).collect()), len(secrets.scan_secrets(docs).collect()))
"""


def test_without_shared_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    for master in ("local", "local[2]"):
        ran = subprocess.run(
            [sys.executable, "-c", CODE.format(master=master)],
            env=os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(ROOT)},
            cwd=tmp_path, capture_output=True, text=True, timeout=300,
        )
        assert ran.returncode == 0 and ran.stdout.split() == ["1", "1"], ran.stderr[-2000:]
