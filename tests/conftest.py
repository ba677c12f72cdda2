import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leaksieve.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        4,
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="4g",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """Make a ``files`` relation from ``{path: text}``."""
    from leaksieve.model import FILES

    def make(texts, mode=0o644):
        rows = [(path, len((text or "").encode()), mode, None, text) for path, text in texts.items()]
        return spark.createDataFrame(rows, FILES)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    from leaksieve.plans.catalog import documents

    return documents(spark, SMALL).cache()
