"""Scratch folder and submitted settings, in sessions of their own."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb

import __spark_entry__ as entry_mod

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str, conf_dir, **env) -> str:
    path = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
    full = {**os.environ, "PYTHONPATH": path, "SPARK_CONF_DIR": str(conf_dir), "SPARK_LOCAL_IP": "127.0.0.1", **env}
    done = subprocess.run([sys.executable, "-c", code], env=full, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_queries_run_without_a_preset_checkpoint_folder(tmp_path):
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["q20_abc_classification"](spark, "/root/testdata/sf0.001").count())
"""
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = len(con.execute(entry_mod.oracle_sql()["q20_abc_classification"]).fetchall())
    assert want and f"ROWS {want}\n" in _run(code, tmp_path)


def test_analyses_stay_when_a_library_of_the_optional_part_is_missing(tmp_path):
    code = """
import sys
for name in ("public_tokenizers", "tokenizers"):
    sys.modules[name] = None  # importing it raises ModuleNotFoundError
import __spark_entry__ as entry
print("KEYS", len(entry.queries()), len(entry.oracle_sql()), any(k.startswith("op") for k in entry.queries()))
"""
    assert "KEYS 27 27 False" in _run(code, tmp_path)


def test_scratch_argument_and_cluster_error(tmp_path):
    code = """
from types import SimpleNamespace as N
from shelfwise.session import scratch_root
spark = N(conf=N(get=lambda k, d: d), sparkContext=N(getCheckpointDir=lambda: None, master="yarn"))
assert scratch_root(spark, "s3://bucket/x/") == "s3://bucket/x"
try:
    scratch_root(spark)
except ValueError as e:
    print("ERROR", e)
"""
    assert "spark.checkpoint.dir" in _run(code, tmp_path)


def test_cli_keeps_submitted_master_and_partitions(tmp_path):
    code = """
import sys
from pyspark.sql import SparkSession
from shelfwise.__main__ import main
sys.argv = ["shelfwise"]
main(["--tpch", "/root/testdata/sf0.001", "q19_discount_impact", "--show", "1"])
"""
    submit = "--master local[2] --conf spark.sql.shuffle.partitions=3 --conf spark.ui.enabled=false pyspark-shell"
    check = code.replace("main([", "import shelfwise.__main__ as m; real = m._open\ndef seen(a):\n    s = real(a); c = s[0]\n    print('CONF', c.sparkContext.master, c.conf.get('spark.sql.shuffle.partitions')); return s\nm._open = seen\nmain([", 1)
    assert "CONF local[2] 3" in _run(check, tmp_path, PYSPARK_SUBMIT_ARGS=submit)
