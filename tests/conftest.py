import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hostwarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 8, "hostwarden-tests")


T0 = 1704110400000000  # 2024-01-01 12:00:00 UTC
SEC = 1_000_000


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts; ``at`` is seconds after noon."""
    from pyspark.sql import functions as F

    from hostwarden import schema

    names = [f.name for f in schema.struct(schema.EVENT_DDL).fields]
    ddl = schema.EVENT_DDL.replace("ts timestamp", "ts bigint")

    def build(rows, **more):
        data = []
        for n, row in enumerate(rows):
            full = {"host_id": "h", "seq": n, "source": "process", "kind": "x", "entity_id": f"e{n}", "message": "m", **more, **row}
            full["ts"] = T0 + int(round(full.pop("at", 0) * SEC))
            data.append(tuple(full.get(c) for c in names))
        return spark.createDataFrame(data, ddl).withColumn("ts", F.timestamp_micros("ts"))

    return build
