import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import build_session

    # Short runs: only the quick compiler of the JVM.
    return build_session("tests", cpus=4, **{"spark.driver.memory": "4g", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"})
