"""The command-line runner."""

from __future__ import annotations

import tempfile

import pytest

from shelfwise.__main__ import main
from shelfwise.plans import ANALYSES
from tests.conftest import TESTDATA


def test_list_prints_every_analysis(capsys):
    assert main(["--list"]) == 0
    assert capsys.readouterr().out.split() == list(ANALYSES)


def test_unknown_analysis_is_an_error(capsys):
    with pytest.raises(SystemExit):
        main(["--tpch", f"{TESTDATA}/sf0.001", "q99_nothing"])


def test_day_argument_only_for_analyses_that_take_one(spark):
    with pytest.raises(SystemExit):
        main(["--tpch", f"{TESTDATA}/sf0.001", "q13_sales_velocity", "--as-of", "2001-10-01"])


def test_run_writes_parquet(spark):
    out = tempfile.mkdtemp(prefix="cli-", dir="/tmp") + "/result"
    assert main(["--tpch", f"{TESTDATA}/sf0.001", "q26_supplier_scorecard", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 8
