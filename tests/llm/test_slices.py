"""What a task holds beside its input batch does not grow with the batch."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from pubwatch.llm import language


def test_counting_a_large_batch_takes_little_memory():
    batch = pa.record_batch([pa.array(["Some words of plain prose, again and again. " * 100] * 2000), pa.array(["en"] * 2000)], ["text", "lang"])
    language.letters()
    tracemalloc.start()
    rows = sum(b.num_rows for b in language._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 128 << 20, f"{peak >> 20} MB beside a batch of {batch.nbytes >> 20} MB"
