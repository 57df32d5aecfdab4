import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from custspark.session import local_session  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8,
        "custspark-tests",
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def data_dir():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def customer_rows(spark, data_dir):
    """The customer table at sf0.01, written once."""
    from custspark.plans.customers import customers
    from custspark.session import materialise

    return materialise(customers(spark, data_dir), "customers")
