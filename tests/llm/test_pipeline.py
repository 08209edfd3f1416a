from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pytest

import corpus_pipeline
from arborweave import session
from arborweave.llm import packing
from tests.llm import plain
from tests.llm.conftest import DOCS
from tests.llm.test_nearcopies import groups


def test_stages(spark, docs, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "secrets", "mixing", "packing"]
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in held.collect()}
        held = stage(spark, held, tables).cache()
        rows = held.collect()
        assert held.columns == docs.columns
        if name == "quality":
            assert 0 < len(rows) < len(before)
        if name == "near duplicates":
            assert sorted(r["doc_id"] for r in rows) == sorted(min(d for d, _ in g) for g in groups(list(before.items())))
        if name == "secrets":
            assert len(rows) == len(before) and not any(plain.base_spans(r["text"]) for r in rows)
            assert sum("[SECRET]" in (r["text"] or "") for r in rows) == sum(bool(plain.base_spans(t)) for t in before.values())
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= set(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, tables)
    assert packed.select("doc_id").distinct().count() == held.select("doc_id").distinct().count()


def test_run(spark, tables, empty_tables):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, tables).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert first and first == again
    assert corpus_pipeline.run(spark, empty_tables).isEmpty()


def most_bytes(spark) -> int:
    """Bytes of the largest batch in which 12 MB of texts come to a Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return max(r["n"] for r in spark.range(3000).coalesce(1).selectExpr("repeat('x', 4000) AS text").mapInArrow(run, "n long").collect())


@pytest.mark.parametrize("name", ["quality", "near duplicates", "packing"])
def test_small_batches(spark, rows, tables, name):
    """A stage that runs Python bounds what its workers get at once, unless the session does."""
    own, set_before = spark.newSession(), spark.newSession()
    assert most_bytes(own) > 2 * session.BATCH_BYTES
    set_before.conf.set(session.BATCH_SETTING, "1m")
    for each in (own, set_before):
        dict(corpus_pipeline.STAGES)[name](each, each.createDataFrame(rows[:20], DOCS), tables)
    assert most_bytes(own) <= session.BATCH_BYTES + 8_000
    assert most_bytes(set_before) <= (1 << 20) + 8_000


def test_word_cache(spark, docs, tables, monkeypatch):
    """The packing stage names a cache far below the operator's own; its rows don't depend on it."""
    asked = []
    pack = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: asked.append(b["cache_words"]) or pack(*a, **b))
    own = corpus_pipeline.pack_sequences(spark, docs, tables)
    assert asked and 4 * asked[0] <= packing.CACHE_WORDS
    whole, few = (pack(docs, corpus_pipeline.queries.tokenizer_path(), cache_words=n) for n in (packing.CACHE_WORDS, 20))
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, own.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, few.select(*key).collect()))
