"""The model's files and blocks when there are many more shards than files."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from pubwatch.llm import kneser_ney as K


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    texts = [" ".join("".join(r.choices("aeinrst", k=r.randint(1, 4))) for _ in range(r.randint(0, 400))) for _ in range(300)]
    return spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string").repartition(4)


def test_many_shards_lie_in_few_files_and_score_alike(docs):
    one, many = K.train(docs), K.train(docs, shard_tokens=20)
    assert one.bits == 0 and many.bits > K.FILE_BITS + 2
    files = os.listdir(many.folder)
    assert len(files) <= sum(len(v) for v in K.LAYOUT.values()) << K.FILE_BITS
    keys = np.sort(np.concatenate([np.fromfile(f"{many.folder}/{f}", np.uint64) for f in files if f.startswith(f"{K.BIGRAM}-") and f.endswith(".0")]))
    assert (keys == np.fromfile(f"{one.folder}/{K.BIGRAM}-0.0", np.uint64)).all()
    first, second = ({r.doc_id: tuple(r)[2:] for r in K.score(docs, m).collect()} for m in (one, many))
    assert first.keys() == second.keys() and len(first) == 301
    assert all(np.allclose(first[k], second[k], rtol=1e-9) for k in first)


def test_lookups_over_many_slices_give_each_text_its_own_score(docs):
    model = K.train(docs)
    whole = {r.doc_id: tuple(r)[2:] for r in K.score(docs, model).collect()}
    table = docs.toArrow()
    ids, texts = table.column(0).to_pylist(), table.column(1).combine_chunks()
    slices = [K.sequence(*K.textual.words(offsets, data)) for _, offsets, data in K.textual.slices(texts, 1000)]
    assert len(slices) > 50
    n, known, base, score = K._row_sums(K.Arrays(model), slices)
    assert all(np.allclose(whole[k], (n[i], known[i], model.tokens, base[i], score[i]), rtol=1e-9) for i, k in enumerate(ids))


def test_contexts_are_gathered_over_shards(tmp_path):
    bits, keys = 8, np.unique(np.random.default_rng(3).integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2))
    rows = list(K._blocks(K.BIGRAM, [keys, np.ones(len(keys), dtype=np.uint64)], bits, 64))
    assert len(rows) == 1 << bits
    out = [r for b in K._merge_counts(str(tmp_path), bits)(iter([K._batch(rows[:100]), K._batch(rows[100:])])) for r in b.to_pylist()]
    sums, blocks = [r for r in out if not r["blob"]], [r for r in out if r["blob"]]
    assert sum(r["a"] for r in sums) == len(keys) and len(sums) == 1 << bits
    # A block for each shard of contexts and of continuations, not one more for each shard of bigrams.
    assert len(blocks) == 2 << bits
