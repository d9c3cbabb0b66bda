"""Pages go to Python workers in batches of bounded bytes."""

from __future__ import annotations

from lodestone.operators import acquisition
from lodestone.operators.shared import BATCH_BYTES

_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_page_class_bounds_its_batches(spark):
    spark.conf.unset(_SETTING)
    pages = spark.createDataFrame([(1, "http://h/p", "<p>a</p>")], "page_id int, url string, html string")
    acquisition.page_class(pages)
    assert spark.conf.get(_SETTING) in (str(BATCH_BYTES), f"{BATCH_BYTES}b")
