from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vacantia.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, app="tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of texts (or tuples of inputs)."""

    def run(fn, inputs):
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
        width = len(rows[0]) - 1
        names = [f"c{k}" for k in range(width)]
        frame = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
        from pyspark.sql import functions as F

        out = frame.select("i", fn(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()
        return [r["v"] for r in out]

    return run
