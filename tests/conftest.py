import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from surprisal.session import get_session

    at = tmp_path_factory.mktemp("spark")
    made = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(at / "warehouse"), "spark.checkpoint.dir": f"file://{at}/shared"})
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture
def segs(spark):
    return lambda *texts: spark.createDataFrame(list(enumerate(texts)), "seg_id bigint, text string")
