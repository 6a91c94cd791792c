"""Company-years that are scored are made once, and scores equal the SQL."""

import duckdb
import pytest

from ledgerline.plans import panel
from ledgerline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["support_summary", "incremental_score"])
def test_company_years_are_made_once(spark, monkeypatch, name):
    made, years = [], panel.company_years
    monkeypatch.setattr(panel, "company_years", lambda *a: made.append(1) or years(*a))
    df = QUERIES[name](spark, SF)
    assert made == [1] and "lineitem" not in df._jdf.queryExecution().toString()
    base = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        base.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    near = lambda rows: sorted(tuple(f"{v:.8f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert near(df.collect()) == near(base.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())
