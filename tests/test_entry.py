import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import ledgerlens.case_queries  # noqa: F401 - registers its queries
import ledgerlens.queries as core

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    assert set(core.SQL) <= set(core.QUERIES)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_agrees_with_its_sql(spark, tiny, name):
    df = core.QUERIES[name](spark, tiny)
    rows = df.collect()
    if name not in core.SQL:
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    found = con.execute(core.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
    assert sorted([shown(r[c]) for c in columns] for r in rows) == sorted([shown(v) for v in r] for r in found.fetchall())


def test_core_without_the_subpackage(tmp_path):
    code = "import sys; sys.modules['ledgerlens.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries()); from ledgerlens.session import build_session; assert e.entry(build_session('alone', 'local[2]')).count() > 0"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
