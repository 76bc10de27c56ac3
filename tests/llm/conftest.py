import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    import fixture_tables

    return fixture_tables.write(spark, tmp_path_factory.mktemp("tables") / "sf")


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    import fixture_tables

    return fixture_tables.write_empty(spark, tmp_path_factory.mktemp("empty") / "sf")
