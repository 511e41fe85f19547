from __future__ import annotations

import pytest

from millrace.llm import importance


def test_the_whole_poor_share_is_left_out(spark):
    labels = spark.createDataFrame([(i, int(i >= 30), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    assert importance.drawn_share(labels) == pytest.approx(0.7)
