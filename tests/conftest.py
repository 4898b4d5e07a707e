import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from reelspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", 4, str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the named columns."""
    picked = [tuple(r) for r in df.collect()]
    if not order:
        return picked
    at = [df.columns.index(c) for c in order]
    return sorted(picked, key=lambda r: tuple((r[i] is None, r[i]) for i in at))
