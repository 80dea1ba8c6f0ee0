import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skyframe.session import build, ship

    session = build("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g",
                    spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                    spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                    spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


def rows(df, *order):
    """Rows as plain tuples, ordered."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r)) if not order else [
        tuple(r) for r in df.orderBy(*order).collect()]
