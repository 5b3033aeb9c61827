"""Importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ferrule.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight string, score string, __words long, bucket string, __rank long"


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams_of(text, n_max):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, n_max=1, buckets=10_000, seed=2024, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams_of(text, n_max)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        grams = grams_of(text, n_max)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams)
        rows.append([i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def fixture(n=60):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)] + ["É", "straße", "日本", "x²", "𝒜b"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(n)]
    docs += [(100, None), (101, ""), (102, "\x00\n--"), (103, "A" * 300_000), (104, "one,Two;three\x00four É-e"), (5, docs[5][1]), (5, docs[5][1] + " more"), (None, docs[7][1]), (None, docs[8][1] + " last")]
    return docs, [docs[3][1], docs[9][1] + " w1 w2", None, "", "É É"]


def tables(spark, docs, target):
    rows = [(i, t, "w", "s", 1, "b", 2) for i, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize(("grams", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 50), (3, 70_000, 100)])
def test_ranks_match_plain_loops(spark, grams, buckets, percent):
    docs, target = fixture()
    left, right = tables(spark, docs, target)
    found = resampling.ranked(left, right, grams=grams, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, target, grams, buckets, percent=percent)


@pytest.mark.parametrize("grams", [1, 2, 4])
def test_blocks_of_words_give_the_same_features(monkeypatch, grams):
    texts = [t for _, t in fixture()[0]]
    whole = [x.tolist() for x in resampling.features(texts, grams, 997)]
    monkeypatch.setattr(resampling, "CHUNK", 7)
    cut = [x.tolist() for x in resampling.features(texts, grams, 997)]
    assert cut[:2] == whole[:2] and sorted(zip(*cut[1:], strict=True)) == sorted(zip(*whole[1:], strict=True))
    for d, text in enumerate(texts):
        assert Counter(b for a, b in zip(*cut[1:], strict=True) if a == d) == Counter(zlib.crc32(g.encode()) % 997 for g in grams_of(text, grams))


def test_drawn_documents_keep_their_columns(spark):
    docs, target = fixture()
    left, right = tables(spark, docs, target)
    found = resampling.resample(left, right, percent=50)
    assert found.columns == left.columns
    drawn = sorted((r[0] for r in plain(docs, target, percent=50) if r[4]), key=str)
    assert sorted((r["doc_id"] for r in found.collect()), key=str) == drawn


def test_empty_tables(spark):
    docs, target = fixture(5)
    left, right = tables(spark, docs, target)
    assert resampling.ranked(left.limit(0), right).collect() == []
    alone = resampling.ranked(left, right.limit(0)).collect()
    assert sorted(map(tuple, alone), key=str) == plain(docs, [])
    with pytest.raises(ValueError, match="percent"):
        resampling.ranked(left, right, percent=101)
