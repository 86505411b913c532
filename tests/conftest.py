import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from langatlas.session import build_session  # noqa: E402
from langatlas.schemas import REPO  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", app="langatlas-tests", shuffle_partitions=8)
    yield s


def owner(location="Bangkok", repos=5, followers=20, login="u"):
    return (login, "User", login, location, repos, followers)


def make_repos(spark, rows):
    """rows: (id, owner tuple or None, [(lang, loc), ...])."""
    data = [(i, f"r{i}", o, [(lang, loc) for lang, loc in langs]) for i, o, langs in rows]
    return spark.createDataFrame(data, REPO)


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def srt(rows):
    return sorted((tuple(r) for r in rows), key=_key)


def rows_of(df, *cols):
    cols = cols or df.columns
    return srt(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
