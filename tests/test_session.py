from types import SimpleNamespace

import pytest

from fleetlens.session import work_folder


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_folder_uses_the_shared_folder_of_the_session():
    first, second = (work_folder(session("yarn", "hdfs://shared/ck/"), "x") for _ in range(2))
    assert first.startswith("hdfs://shared/ck/x-") and first != second


def test_only_a_local_session_may_leave_it_out():
    assert "fleetlens-" in work_folder(session("local[4]"), "x")
    with pytest.raises(ValueError):
        work_folder(session("yarn"), "x")
