import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"
DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from recordloom.session import session

    s = session("tests", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="4g", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def as_rows(frame):
    """Rows of a pandas frame in an order of their own, numbers and nulls alike whatever their types."""
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(v):
        if pd.isna(v) is True:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(round(float(v), 6))
        return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False))
