import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from demandloom.session import local_session, ship_package

    session = local_session(8, "tests", memory="8g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a schema string and tuples; ISO text becomes a date."""
    import datetime as dt

    def build(schema: str, *data):
        kinds = [c.split()[1] for c in schema.split(",")]
        typed = [
            tuple(dt.date.fromisoformat(v) if k == "date" and v else v for v, k in zip(row, kinds)) for row in data
        ]
        return spark.createDataFrame(typed, schema)

    return build


def values(df, *columns, order=None):
    """Rows as tuples of the named columns, sorted."""
    table = df.orderBy(*(order or columns)).select(*columns)
    return [tuple(r) for r in table.collect()]
