"""What a Python task is handed at once does not grow with the rows of its partition."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from pubwatch.llm import language, textual
from pubwatch.session import BATCH_BYTES, bounded_batches
from pubwatch.sources import html

#: A batch ends with the row that reaches the limit.
LONGEST = 1 << 13
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(rows) -> int:
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["bytes"])

    return rows.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]


def test_operators_bound_the_batches_of_python_tasks(spark):
    texts = spark.range(0, 6000, 1, 1).select(F.concat("id", F.repeat(F.lit(" some words of prose"), 200)).alias("text"))
    for plan in (lambda: language.identify(texts, {}), lambda: html.with_nodes(texts, "text")):
        spark.conf.unset(KEY)
        unbounded = _largest(texts)
        plan()
        assert _largest(texts) < BATCH_BYTES + LONGEST < unbounded


def test_smaller_batches_of_the_session_stay(spark):
    try:
        for given, then in (("1m", "1m"), ("1g", f"{BATCH_BYTES}b")):
            spark.conf.set(KEY, given)
            bounded_batches(spark)
            assert spark.conf.get(KEY) == then
    finally:
        spark.conf.unset(KEY)


def test_slices_of_a_batch_are_a_quarter_of_a_megabyte():
    parts = [len(data) for _, _, data in textual.slices(pa.array(["y" * 5000] * 1000))]
    assert max(parts) <= 1 << 18 and sum(parts) == 5_000_000
