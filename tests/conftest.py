import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rowlantern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def small_splits(spark):
    """Cut files into splits of a few bytes, so that every boundary case occurs."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "4")
        spark.conf.set(names[2], "1")

    yield use
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


@pytest.fixture
def put(tmp_path):
    """Write one file into its own folder and give its path."""
    def write(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return str(path)

    return write


@pytest.fixture
def out(tmp_path):
    count = iter(range(1000))
    return lambda: str(tmp_path / f"out-{next(count)}")


def parts(folder):
    """Part files of a written folder, in order, as bytes."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    return [open(os.path.join(folder, n), "rb").read() for n in names]


def in_order(df):
    return df.orderBy("file", "record_id").collect()
