import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from brindle.session import local_session

    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    """DuckDB views of the tables at the size of the correctness gate."""
    import duckdb

    con = duckdb.connect()
    folder = f"{DATA}/sf0.01"
    for f in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v).astype(str).str.replace(r"\.0$", "", regex=True)
    return sorted(map(tuple, df.values))
