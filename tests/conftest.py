import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from lexiloom.session import local_session, ship

    session = local_session("4", "tests", **{"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield ship(session)
    session.stop()


@pytest.fixture
def col(spark):
    """Value of a column expression over one row of named values."""

    def run(expression, **values):
        schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x int"
        return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(expression.alias("out")).first().out

    return run
