import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import local_session
    s = local_session(8, shuffle_partitions=8, memory="8g", app="ledgerlake-tests")
    yield s
    s.stop()


@pytest.fixture()
def order_data(spark):
    """The reference test class's 5-order fixture, in canonical column names."""
    rows = [(i + 1, f"R{i + 1}", c, float(t), datetime(2023, 1, i + 1), "F", "card", "FR")
            for i, (t, c) in enumerate(zip([100, 200, 300, 400, 500], ["A", "B", "A", "C", "A"]))]
    return spark.createDataFrame(rows, "id long, reference string, client string, total double, "
                                       "date timestamp_ntz, state string, payment string, country string")


@pytest.fixture()
def cart_data(spark):
    rows = [(i + 1, r, c, float(t), datetime(2023, 1, i + 1))
            for i, (r, c, t) in enumerate(zip(["R1", "R2", "X1", "X2"], "ABDE", [50, 60, 70, 80]))]
    return spark.createDataFrame(rows, "id long, order_ref string, client string, total double, date timestamp_ntz")
