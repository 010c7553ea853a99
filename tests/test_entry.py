import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark import probes

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else str(v)


def rows(pdf):
    return sorted((tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(probes.ORACLES))
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.execute(probes.ORACLES[name]).df()
    got = probes.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "tidemark"
    found = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"(from|import)[^\n]*\bllm\b", p.read_text())]
    assert not found


def test_queries_have_no_nested_loops_over_growing_tables(spark):
    for name in ("op_j01_blocked_lookup", "op_j04_best_match", "op_j08_suffix_class", "op_j22_duplicates"):
        plan = probes.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan, name
        assert "Cartesian" not in plan, name
