import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.checkpoint.dir", str(shared / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same_rows(a, b, tolerance=1e-9):
    """Two frames hold the same rows, in any order."""
    import numpy as np

    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if str(a[c].dtype) == "bool":
            assert a[c].tolist() == b[c].tolist(), c
        elif a[c].dtype == object or b[c].dtype == object or "date" in str(b[c].dtype):
            left, right = (["" if v is None or v != v else str(v)[:10] if "date" in str(type(v)).lower() or "timestamp" in str(type(v)).lower() else str(v) for v in x[c]] for x in (a, b))
            assert left == right, c
        else:
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=0, atol=tolerance, err_msg=c)
