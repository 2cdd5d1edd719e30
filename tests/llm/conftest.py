from __future__ import annotations

import pytest

from sheetseam.llm.common import ready


@pytest.fixture(scope="session")
def llm(spark):
    """The session, ready for these operators; texts travel in batches of three rows so that tests see several."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    ready(spark)
    return spark
