from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score int"
VOWELS = {"en": ("th", "er", "on", "an", "ing", "ble"), "fr": ("é", "eau", "oi", "tre", "ê", "ment"), "de": ("sch", "ung", "keit", "ü", "ein", "pf")}


def prose(r: random.Random, lang: str, words: int) -> str:
    return " ".join("".join(r.choice(VOWELS[lang]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(words))


def build(seed: int = 7, n: int = 150) -> list[tuple]:
    """Documents with nulls, empty and long texts, exact and near copies, bad text and secrets; last columns clash with operators' names."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(VOWELS))
        text: str | None = prose(r, lang, r.choice([1, 2, 3, 5, 20, 80, 300]))
        if i % 9 == 1:
            text = " ".join(w.upper() + "!!" for w in prose(r, lang, 40).split())
        if i % 11 == 2 and out:
            text = out[r.randrange(len(out))][1]
        if i % 13 == 3 and out:
            words = (out[r.randrange(len(out))][1] or "x y z").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 17 == 4:
            text = (text or "") + f' token = "{r.getrandbits(160):040x}" end'
        if i == 40:
            text = None
        if i == 41:
            text = ""
        if i == 42:
            text = " \n\t"
        if i == 43:
            text = prose(r, "en", 30_000)
        if i == 44:
            text = "a" * 5_000
        if i == 45:
            text = "😀é\x00ÀB \x0b\x1cword"
        out.append((i * 3 + 1, text, None if i % 31 == 5 else lang, None if i % 23 == 6 else "src0" if i % 3 == 0 else f"src{i % 7}", i % 5, "clash", None))
    return out


@pytest.fixture(scope="session")
def rows():
    return build()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """As docs, with repeated rows, null ids and one id with two texts."""
    return spark.createDataFrame([*rows, *rows[:20], *rows[40:43], (None, "no id here at all", "en", "src1", 1, "", 1), (None, None, None, None, None, None, None), (rows[3][0], "another text of the same id", "en", "src2", 2, "", 2)], DOCS).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tables(spark, docs, rows, tmp_path_factory):
    """A folder of tables as queries read them."""
    base = tmp_path_factory.mktemp("tables")
    r = random.Random(5)
    docs.write.parquet(f"{base}/documents.parquet")
    labels = [(d, 0 if (t or "").isupper() or "!!" in (t or "") else 1, 0) for d, t, *_ in rows if r.random() < 0.8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    vectors = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(30)]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    return str(base)


@pytest.fixture(scope="session")
def empty_tables(spark, no_docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    no_docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{base}/embeddings.parquet")
    return str(base)
