import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cellforge.session import local_session, ship

    session = local_session("4", 4, **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield ship(session)
    session.stop()
