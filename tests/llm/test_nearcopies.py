"""The pipeline's near-duplicate stage against all pairs of exact Jaccard similarities."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from arborweave.llm import nearcopies, simhash
from tests.llm import plain
from tests.llm.conftest import DOCS


def shingles(text, n=5):
    words = plain.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())


def groups(rows):
    """Rows (doc_id, text) by component of pairs at 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = defaultdict(list)
    for i, row in enumerate(rows):
        out[find(i)].append(row)
    return list(out.values())


def stage(spark, rows, tables=""):
    df = spark.createDataFrame([(d, t, "en", "s", 0, "", 0) for d, t in rows], DOCS).repartition(3)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, tables).collect()]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def test_near_copies_above_two_bits(spark):
    """Copies with one word in a hundred replaced: about 0.9, and mostly beyond two bits of a fingerprint."""
    r = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.choice([60, 100, 300, 1000]))]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, edited(r, words, len(words) // 100 or 1)), (10 * i + 2, edited(r, words, len(words) // 8))]
    assert len(stage(spark, rows)) == len(groups(rows)) < 125


def test_stage_of_the_fixture(spark, rows):
    want = sorted(min(d for d, _ in g) for g in groups([(d, t) for d, t, *_ in rows]))
    assert sorted(d for d, _ in stage(spark, [(d, t) for d, t, *_ in rows])) == want


def test_one_large_group(spark):
    """Copies of copies: near to few others each, and joined through them."""
    r = random.Random(6)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = edited(r, words, 1).split() if i % 3 else words
        rows.append((i, edited(r, words, i % 2)))
    got = stage(spark, rows)
    assert sorted(d for d, _ in got) == sorted(min(d for d, _ in g) for g in groups(rows))


def test_recall_of_candidates_at_the_threshold():
    """Pairs at exactly 0.8: nearly all share a band within the radius, and every one passes the exact bounds."""
    r = np.random.default_rng(3)
    missed, distances = 0, []
    for i in range(1500):
        k = (0, 2, 9, 45)[i % 4]
        x = r.integers(0, 1 << 63, 10 * k or 5, dtype=np.uint64)
        a, b = (np.unique(x[: 9 * k]), np.unique(x[k:])) if k else (np.unique(x[:4]), np.unique(x))
        assert nearcopies.similar(a, b)
        distances.append((simhash.majority(a) ^ simhash.majority(b)).bit_count())
        missed += distances[-1] > nearcopies.RADIUS or not set(nearcopies.band_keys(a)) & set(nearcopies.band_keys(b))
        at, _ = nearcopies.may_be_similar(np.array([len(a), len(b)]), nearcopies.Sketches([nearcopies.sketch(a), nearcopies.sketch(b)]), np.array([0]), np.array([1]))
        assert len(at) == 1
    assert missed <= 2 and 8 < np.mean(distances) < 12


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(4)
    for _ in range(300):
        x = r.integers(0, 1 << 63, r.integers(1, 3000), dtype=np.uint64)
        a, b = np.unique(x[r.random(len(x)) < 0.8]), np.unique(x[r.random(len(x)) < 0.4])
        differ = nearcopies.Sketches([nearcopies.sketch(a), nearcopies.sketch(b)]).differing(np.array([0]), np.array([1]))
        assert differ[0] <= len(np.setxor1d(a, b))


def test_large_bands_are_dealt_in_groups(spark, monkeypatch):
    """Groups of seven points: the same rows stay."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, edited(r, words, i % 5)) for i in range(80)]
    whole = stage(spark, rows)
    monkeypatch.setattr(nearcopies, "SHARD_POINTS", 7)
    assert sorted(stage(spark, rows)) == sorted(whole)
    assert sorted(d for d, _ in whole) == sorted(min(d for d, _ in g) for g in groups(rows))


def test_odd_rows_and_clashing_names(spark, odd_docs, no_docs):
    clash = odd_docs.withColumns({c: F.lit(7) for c in ("row", "id", "unnamed", "text_hash", "sid", "kept", "doubtful", "sieve_key", "bands")})
    kept = nearcopies.deduplicated(clash)
    assert kept.columns == clash.columns
    seen = Counter(r["doc_id"] for r in kept.collect())
    assert max(seen.values()) <= 2 and seen[None] <= 1
    assert nearcopies.deduplicated(no_docs).isEmpty()


def test_one_row_stays_of_repeated_and_null_ids(spark):
    r = random.Random(7)
    a, b = ([f"{k}{r.randrange(10**6)}" for _ in range(200)] for k in "ab")
    copies = [edited(r, a, 1) for _ in range(4)]
    rows = [(1, " ".join(a)), (2, copies[0]), (2, copies[1]), (2, " ".join(b)), (None, copies[2]), (None, edited(r, b, 1)), (None, "alone with no id and no copy"), (1, " ".join(a)), (None, None), (3, "")]
    got = stage(spark, rows)
    assert sorted(got, key=str) == sorted([(1, " ".join(a)), (2, " ".join(b)), (None, "alone with no id and no copy"), (3, "")], key=str)
