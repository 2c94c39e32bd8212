import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stratafold.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=8, app="tests", memory="8g")


def rows(df, *cols):
    """Sorted plain tuples of a small DataFrame."""
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) if cols else sorted((tuple(r) for r in df.collect()), key=repr)
