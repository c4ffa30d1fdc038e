import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import get_session, ensure_checkpoint_dir
    s = get_session("local[4]", app="kestrel-tests", shuffle_partitions=4, driver_memory="6g")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="kestrel-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="kestrel-test-")
