import tempfile

import pytest

from siterank.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "siterank-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="siterank-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
