"""Every query over the fixture's tables against plain definitions; and over empty tables."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from arborweave.llm import langid, queries, quality
from tests.llm import plain

Q = queries.QUERIES


def collected(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in collected(df)}


def test_op1(spark, tables, rows):
    got = by_id(Q["op1_phrase_fingerprints"](spark, tables))
    after = plain.next_texts(rows)
    assert set(got) == {d for d, *_ in rows}
    for d, text, *_ in rows:
        assert got[d]["n_chars"] == len(text or "")
        assert got[d]["edited_sha256"] == plain.edited_sha256(text, after[d])
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        for name, t in (("fingerprint", text), ("edited_fingerprint", plain.edited(text, after[d]))):
            if len(t or "") < 20_000:
                ranks = np.frombuffer(bytes.fromhex(got[d][name]), ">u4").astype(np.uint32).view(np.float32)
                assert np.allclose(ranks, plain.phrase_sketch(t), rtol=2e-6)
    same = defaultdict(set)
    for d, text, *_ in rows:
        same[text or ""].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) >= len(same) - 3  # near copies may share a sketch
    long = [got[d] for d, t, *_ in rows if len(t or "") > 300 and t != "a" * 5_000]
    assert np.mean([r["near_edited"] for r in long]) > 0.35
    assert np.mean([r["near_next"] for r in long]) < 0.1


def test_op2(spark, tables, rows):
    got = by_id(Q["op2_simhash_components"](spark, tables))
    prints = {d: plain.simhash(t) for d, t, *_ in rows}
    want = plain.near_components(list(prints.items()))
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{f:016x}", want[f]) for d, f in prints.items()}


def test_op3(spark, tables, rows):
    first = collected(Q["op3_curriculum_mix"](spark, tables))
    sizes, source = defaultdict(int), {}
    for d, t, _, s, *_ in rows:
        sizes[s] += plain.size_in_words(t)
        source[d] = s
    want = plain.targets(sizes)
    taken = defaultdict(int)
    for r in first:
        assert r["size"] == plain.size_in_words(next(t for d, t, *_ in rows if d == r["doc_id"]))
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2
    places = [r["position_1"] for r in first if r["position_1"] is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert [r["doc_id"] for r in collected(Q["op3_curriculum_mix"](spark, tables))] == [r["doc_id"] for r in first]


def test_op4(spark, tables):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in collected(Q["op4_threshold_top_k"](spark, tables)))
    assert got == plain.top_k(vectors)


def test_op5(spark, tables, rows):
    got = by_id(Q["op5_compression_quality"](spark, tables))
    assert set(got) == {d for d, *_ in rows}
    for d, r in got.items():
        assert r["held_out"] == (plain.crc_mod(d, 5) == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.3)
    text = {d: t or "" for d, t, *_ in rows}
    bad = [r["score"] for d, r in got.items() if len(text[d]) > 100 and "!!" in text[d]]
    good = [r["score"] for d, r in got.items() if len(text[d]) > 100 and "!!" not in text[d]]
    assert np.mean(bad) < 0.3 < 0.8 < np.mean(good)


def test_op6(spark, tables, rows):
    got = collected(Q["op6_kd_tree_shards"](spark, tables))
    text = {d: (t or "").encode() for d, t, *_ in rows}
    slots = defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    # A k-d tree: at each node one dimension tells the two halves apart, and their bytes are near equal but for one text.
    by_size, by_crc = (lambda r: (r["size"], r["text_crc32"], r["doc_id"])), (lambda r: (r["text_crc32"], r["size"], r["doc_id"]))
    for first, leaves in ((0, 8), (0, 4), (4, 4), (0, 2), (2, 2), (4, 2), (6, 2)):
        low, high = ([r for r in got if a <= r["shard"] < a + leaves // 2] for a in (first, first + leaves // 2))
        assert not low or not high or any(max(map(key, low)) < min(map(key, high)) for key in (by_size, by_crc))
        sizes = [sum(r["size"] for r in x) for x in (low, high)]
        assert abs(sizes[0] - sizes[1]) <= 2 * max((r["size"] for r in low + high), default=0)


def test_op7(spark, tables, rows):
    import hashlib

    got = by_id(Q["op7_entropy_secrets"](spark, tables))
    for d, t, *_ in rows:
        spans = plain.base_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(plain.joined(spans).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == k for s in spans) for k in ("assign", "access", "hex")]
        assert got[d]["spans"] == plain.joined(spans)  # nothing to add here


def test_op8(spark, tables, rows):
    got = by_id(Q["op8_ngram_language"](spark, tables))
    right = []
    model = plain.language_model([(t, lang) for d, t, lang, *_ in rows if lang is not None and plain.crc_mod(d, 3) != 1])
    for d, t, *_ in rows[::4]:
        if len(t or "") < 5_000:
            name, score = plain.language(t, model)
            assert got[d]["lang_pred"] == name and got[d]["score"] == pytest.approx(score, abs=1e-3)
    for d, t, lang, *_ in rows:
        assert got[d]["held_out"] == (plain.crc_mod(d, 3) == 1) and 0 <= got[d]["score"] <= 1
        if not any(map(str.isalpha, t or "")):
            assert got[d]["lang_pred"] == "und" and got[d]["score"] == 0
        elif lang is not None and got[d]["held_out"] and len(t) > 60 and t != "a" * 5_000:
            right.append(got[d]["lang_pred"] == lang)
    assert len(right) > 10 and np.mean(right) > 0.8  # copies may carry another label


def test_op9(spark, tables, rows):
    got = by_id(Q["op9_feistel_pseudonyms"](spark, tables))
    assert all(got[d]["text"] == t for d, t, *_ in rows)  # nothing personal here


def test_op10(spark, tables, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.add((d, p, a, len(part), zlib.crc32(part.tobytes())))
    got = collected(Q["op10_best_fit_packing"](spark, tables))
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= sum(r["length"] for r in got) / 2048 + 1


@pytest.mark.parametrize("name", list(Q))
def test_empty_tables(spark, empty_tables, name):
    assert Q[name](spark, empty_tables).isEmpty()


def test_whole_tables_at_sf001():
    """Queries read tables by name alone: no filters on ids, limits or prefixes in their text."""
    import inspect

    source = inspect.getsource(queries)
    assert ".limit(" not in source and ".sample(" not in source and "substring" not in source


def test_models_ignore_held_out_rows(spark, docs):
    labels = spark.createDataFrame([(d, 1, 0) for d in range(500) if plain.crc_mod(d, 5) == 0], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels) == quality.Model()
    only = docs.filter(langid.held_out(docs["doc_id"]))
    assert langid.train(only).languages == []
