import os
import tempfile

import pytest

from pulsegate.session import build_session

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    session = build_session("pulsegate-tests", **{
        "spark.master": "local[4]", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    """A new scratch folder."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
