"""The pipeline's stages against what they must keep."""

import random
import re
import tempfile

import pytest

import corpus_pipeline
from ferrule.llm import nearcopies
from ferrule.llm.queries import ORACLES, QUERIES


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1)) and set(ORACLES) <= set(QUERIES)


def test_stages_in_order_and_their_columns(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.5 * sizes[0]
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset", "start", "length", "ids_crc32", "loss_tokens").distinct().collect())) for _ in range(2))
    assert first == again and {r[0] for r in first} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize(("first_round", "growth"), [(16, 8), (1, 8)])
def test_near_copies_match_brute_force(spark, first_round, growth):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    passage, texts = r.choices(words, k=60), []
    for size in (40, 90, 200):
        base = r.choices(words, k=size)
        for n in range(12):
            copy = list(base)
            for at in r.sample(range(size), max(1, n * size // 240)):
                copy[at] = f"x{r.randint(0, 9**9)}"
            texts.append(" ".join(copy))
    texts += [" ".join(passage + r.choices(words, k=k)) for k in (2, 3, 5, 8, 20, 40) for _ in range(3)] + ["a b", "A  b", "", " ", None]

    def parts(t):
        found = (t or "").lower().split()
        return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} or {tuple(found)}

    sets, root = [parts(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = corpus_pipeline.near_duplicates(spark, docs, "") if first_round == 16 else nearcopies.keep_one(docs, first_round, growth)
    kept = {x["doc_id"] for x in made.collect()}
    assert kept == set(root) and 10 < len(kept) < len(texts) - 15


def _prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 500)}" for _ in range(n))


def test_stages_on_odd_rows(spark):
    """Nulls, an empty and a very long text, repeated and tied rows, two texts under one id, and columns named like the operators' own."""
    twin, other, sentence = _prose(1, 80), _prose(2, 80), "This line is licensed to be copied by all who read it."
    texts = [(1, twin), (2, twin), (2, other), (2, other), (None, _prose(3, 60)), (None, _prose(3, 60)), (7, None), (8, ""), (9, _prose(4, 30_000)), (10, "few words")]
    texts += [(20 + i, f"{_prose(40 + i, 40)}\n{sentence}\n{_prose(80 + i, 40)}") for i in range(6)]
    rows = [(i, t, None if n == 3 else "en", None if n % 5 == 0 else f"s{n % 2}", n, 1000 + n, f"k{n}", n) for n, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copy long, shuffle_key string, n int")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        where = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, "").write.parquet(where)
        docs = spark.read.parquet(where)
        now = docs.collect()
        counts.append(len(now))
        assert docs.columns == columns and {r["copy"] for r in now} <= {r["copy"] for r in before}
        if name == "quality_rules":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in now} == {7, 8, 10}
        if name == "line_dedup":
            assert sum(sentence in (r["text"] or "") for r in now) == 1 and {r["doc_id"] for r in now} >= {9, *range(20, 26)}
        if name == "simhash_near_dedup":
            assert len(now) == len({r["text"] for r in now}) == len({r["text"] for r in before})
        if name == "mixing":
            assert {(r["copy"], r["shuffle_key"]) for r in now} <= {(1000 + n, f"k{n}") for n in range(len(rows))}
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert sum(r["start"] == 0 for r in pieces) == counts[-1] > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), "").count() == 0, name


@pytest.mark.parametrize("bits", [1, 4])
def test_sets_of_one_short_name_stay_apart(spark, bits):
    """With names narrowed to a few bits nearly all sets clash, and the result is the same."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(25)]
    texts += [t.replace(t.split()[30], "changed", 1) for t in texts[:8]] + texts[8:12] + ["", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    wide, narrow = ({x["doc_id"] for x in nearcopies.keep_one(docs, bits=n).collect()} for n in (64, bits))
    assert wide == narrow and set(range(25)) <= wide and len(wide) < len(texts)


def test_operator_1_links_near_copies_first(spark, monkeypatch):
    """The stage goes through operator 1's fingerprints and index, and what those link is verified by similarity."""
    base = _prose(5, 900).split()
    texts = [" ".join(base), " ".join([*base[:899], "x"]), " ".join([*base[:450], "y", *base[451:]]), _prose(6, 900), "alone"]
    fps = [nearcopies.fingerprint(nearcopies.shingles(t)) for t in texts]
    near = [(a, b) for a in range(5) for b in range(a) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2]
    seen, plain = [], nearcopies._similar

    def similar(pairs, sets, work):
        seen.append({tuple(x) for x in pairs.collect()})
        return plain(pairs, sets, work)

    monkeypatch.setattr(nearcopies, "_similar", similar)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    node = [nearcopies.node_of(nearcopies.shingles(t))[0] for t in texts]
    assert {x["doc_id"] for x in nearcopies.keep_one(docs).collect()} == {0, 3, 4} and near
    assert {tuple(sorted((node[a], node[b]))) for a, b in near} <= seen[0]


def test_large_sets_of_one_pool_are_not_compared_in_pairs(spark, monkeypatch):
    """Long texts of common passages share most of their postings, yet are no near copies; their parities tell."""
    r = random.Random(11)
    pool = [_prose(100 + i, 120) for i in range(20)]
    texts = [" ".join(r.sample(pool, 10)) for _ in range(60)]
    seen, plain = [], nearcopies._similar

    def similar(pairs, sets, work):
        seen.append(pairs.count())
        return plain(pairs, sets, work)

    monkeypatch.setattr(nearcopies, "_similar", similar)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(nearcopies.shingles(t).tolist()) for t in texts]
    near = [(a, b) for a in range(60) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert nearcopies.keep_one(docs).count() >= 60 - len(near) and sum(seen) <= 60 + 2 * len(near)
