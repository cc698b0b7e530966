import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark import cloudpickle

    import twinlens
    from twinlens.session import build_session

    cloudpickle.register_pickle_by_value(twinlens)
    session = build_session(
        "local[4]", "twinlens-tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
