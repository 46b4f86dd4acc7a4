"""Every query with a SQL counterpart gives the same rows, names and types."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
MODEL_SF = "/root/testdata/sf0.01"  # the models need some signal
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


MODELS = {n for n in ORACLES if n.startswith(("logistic_", "stepwise_", "hand_selected_", "cox_", "pooled_"))}


@pytest.fixture(scope="module")
def connections():
    return {sf: connect(sf) for sf in (SF, MODEL_SF)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connections, name):
    verdict = "no rows" if name in MODELS else compare(QUERIES[name](spark, SF), connections[SF], ORACLES[name])
    if verdict == "no rows":
        verdict = compare(QUERIES[name](spark, MODEL_SF), connections[MODEL_SF], ORACLES[name])
    assert verdict == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, MODEL_SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r["criterion"] for r in rows} == {"initial", "exclude-age", "exclude-dx", "eligible"}
    assert len(rows) == 20
    by = {(r["site"], r["criterion"]): r["pat_cnt"] for r in rows}
    for site in {r["site"] for r in rows}:
        assert by[site, "eligible"] <= by[site, "initial"]


@pytest.mark.parametrize("missing", ["public_tokenizers", "cohortloom.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_operators(missing):
    """A missing package costs the queries that need it and no other."""
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert 'attrition' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q), sorted(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry_module.__file__)))
