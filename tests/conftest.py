from __future__ import annotations

import pytest

from quantell.plans.shared import drop_written
from quantell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    drop_written()
    session.stop()


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
