import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from matchlake.session import session

    s = session("local[4]", 4, {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('scratch')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(pdf):
    """Rows as sorted tuples of strings, columns by name."""
    import pandas as pd

    def show(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return "None"
        if isinstance(v, (str, bool)) or not hasattr(v, "__float__"):
            return str(v)
        return str(int(v)) if float(v) == int(v) else f"{float(v):.11g}"  # a column of whole numbers with nulls holds floats

    return sorted(tuple(map(show, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None))
