"""Every operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ferrule.llm import common, langid, linededup, media, mixing, nearcopies, packing, pii, quality, simhash, suffix, warc
from ferrule.llm.common import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, n string, __m string, __n string, gone string, __s string, __h string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, texts, ids=None, langs=None, sources=None):
    rows = []
    for i, t in enumerate(texts):
        doc = ids[i] if ids else i
        rows.append((doc, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), 1, *"knmngsh"))
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "One two", "É É É\x85x", prose(1, 4000), prose(2, 60), prose(2, 60), "é" * 500]


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps, bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(sorted(set(fps)), 2):
        if bin(a ^ b).count("1") <= bits:
            root[find(b)] = find(a)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("long_list", [64, 1])
def test_simhash_matches_brute_force(spark, long_list):
    base = prose(5, 300).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 300, 10)]
    texts = ODD + near + [prose(5, 300), "ONE two", prose(9, 30)]
    ids = [None, *range(1, len(texts))]
    ids[8] = ids[7]
    got = simhash.near_duplicates(table(spark, texts, ids), long_list=long_list).collect()
    fps = [slow_fingerprint(t) for t in texts]
    root = components_of(fps, 2)
    least = defaultdict(list)
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[root[f]].append(i)
    want = Counter((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in zip(ids, fps, strict=True))
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("long_list", [64, 2])
def test_simhash_links_lose_none(spark, long_list):
    r = random.Random(3)
    core = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in core for _ in range(60)} | {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = Counter(tuple(x) for x in simhash.links(df, Workspace(spark, "t"), long_list=long_list).collect())
    signed = sorted(simhash._signed(f) for f in fps)
    want = Counter((a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    assert got == want and len(want) > 50


def test_near_copies_keep_one_row_of_each_group(spark):
    """Different texts under one doc_id are different documents; ids that are null come last."""
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    for rows, want in [
        ([(1, b), (5, a), (5, b)], [(1, b), (5, a)]),
        ([(4, a), (3, a), (9, b), (9, b), (None, a), (None, c), (None, c)], [(3, a), (9, b), (None, c)]),
        ([(7, None), (6, ""), (8, " \n")], [(6, "")]),
    ]:
        for order in (rows, rows[::-1]):
            kept = nearcopies.keep_one(table(spark, [t for _, t in order], [i for i, _ in order]))
            assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(want) and kept.columns == table(spark, [""]).columns
    assert nearcopies.keep_one(table(spark, ["x"]).where("false")).collect() == []


def slow_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(r, gone, strict=True) if not x)
        out.append((len(r), sum(gone), sum(1 for i in range(len(r)) if gone[i] and not (i and gone[i - 1])), kept))
    return out


@pytest.mark.parametrize(("part", "length", "gram", "batches"), [(16_384, 40, 16, 3), (3, 24, 8, 2), (16_384, 200, 64, 4)])
def test_suffix_matches_brute_force(spark, part, length, gram, batches):
    r = random.Random(part + length)
    pieces = ["".join(r.choice("abé\n") for _ in range(r.randint(5, 90))) for _ in range(6)]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 8))) for _ in range(40)] + ODD + ["a" * 700, "ab" * 150, "xy" + "ab" * 120]
    got = suffix.remove_repeats(table(spark, texts), length, gram, batches, part).orderBy("doc_id").collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got] == slow_removed(texts, length)


def test_suffix_family_levels_grow_geometrically(spark):
    family = suffix.Family(Workspace(spark, "t"))
    for i in range(5):
        family.add(suffix.suffix_array(table(spark, [prose(i, 100)])))
    assert [rank for rank, _, _ in family.levels] == [2, 0]


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def test_base_spans_match_the_plain_patterns():
    r = random.Random(1)
    bits = ["4111111111111111", "1.2.3.4.5.6.7.8", "a@b.c%d@e.f", " 12 555-1234-5678-90", "4111 1111-1111 1111 ", "001.002.3.4", "x@y.z.", "+1 (521) 555-6869", "300.1.1.1"]
    for n in range(4000):
        text = "".join(r.choice("a@.b1234 -+%()@..9\n") for _ in range(r.randint(0, 40))) if n % 2 else "+".join(r.choice(bits) for _ in range(4))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == want, text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "a" * 200_000) == []


def field_of(text):
    nodes = pii.Nodes(text, pii.base_spans(text))
    return nodes, np.array(nodes.cells), nodes.seen, pii._pairs([x for e in nodes.chain for x in e]), pii._pairs([x for e in nodes.skip for x in e])


def test_skip_chain_carries_labels_to_repeats_and_leaves_others(spark):
    known = [f"call +1 (521) 555-{1000 + i} or write a{i}@mail.example.com about version 2.0.{i}" for i in range(80)]
    doc = "Ring +1 (333) 555-7777 today. " + "plain words here. " * 30 + "Again 555-7777 is the line, chapter 7 of 12."
    outside = [f"see part 555-{1000 + i % 9000} of {i} and 12.{i}" for i in range(3000)]  # many tokens of the repeat's shape: it is found all the same
    for more in ([], outside):
        rows = {r["doc_id"]: r for r in pii.personal_data(table(spark, [*known, doc, "no data, only 12 eggs", None, "", *more])).collect()}
        added = [s for s in rows[80]["spans"].split(",") if int(s.split(":")[1]) > 40]
        assert [doc[int(a) : int(b)] for _, a, b in (s.split(":") for s in added)] == ["555-7777"] and rows[80]["n_phone"] == 1 and rows[80]["n_added"] == 1
        for i in (81, 82, 83):
            assert rows[i]["spans"] == "" and rows[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[i]["n_found"] == 0
        assert rows[0]["n_email"] == rows[0]["n_phone"] == 1 and rows[0]["n_card"] == 0 and sum(r["n_added"] for r in rows.values()) == 1


def test_field_on_given_tables(spark):
    """What the field adds there are numbers with a card's checksum that run into another; planted repeats are found, clean documents left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    planted, want = {}, {}
    for i, text in texts.items():
        phones = [text[a:b] for a, k, b in pii.base_spans(text) if k == 3]
        if phones and phones[0][-8:] not in text.replace(phones[0], ""):
            planted[i] = f"{text}\nplain words. {phones[0][-8:]} again"
            want[i] = f"phone:{len(planted[i]) - 14}:{len(planted[i]) - 6}"
    two = "7536784127813050 4845168114407329"
    rows = pii.personal_data(spark.createDataFrame([(i, planted.get(i, t)) for i, t in texts.items()] + [(10**6, f"pay {two} now")], "doc_id long, text string"), docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(want) >= 10 and sum(w in found[i]["spans"].split(",") for i, w in want.items()) >= 0.9 * len(want)
    assert found[10**6]["spans"] == "card:4:20,card:21:37" and found[10**6]["n_added"] == 2 and found[10**6]["n_card"] == 0
    extra = [(i, s) for i, r in found.items() if i != 10**6 for s in set(r["spans"].split(",")) - set(pii._joined(pii.base_spans(planted.get(i, texts[i]))).split(",")) if s != want.get(i)]
    assert all(pii.luhn(planted.get(i, texts[i])[int(a) : int(b)]) for i, s in extra for _, a, b in [s.split(":")])
    for i, r in found.items():
        if i in texts:
            assert r["n_found"] >= 1 or not pii.base_spans(texts[i]) and 'token = "' not in texts[i]


def test_secrets_by_name_and_by_repeat(spark):
    key = "11acdfb36bb72224148e6160f674b4be45601bff"
    texts = [f'set token = "{key[i:]}{key[:i]}" now' for i in range(30)] + [f'token = "{key}" then later {key} again', f"the hash {key} alone"] + [f"{n} eggs and {n + 7} more" for n in range(50)]
    rows = {r["doc_id"]: r for r in pii.personal_data(table(spark, texts)).collect()}
    assert [rows[i]["n_secret"] for i in (0, 30, 31, 40)] == [1, 2, 0, 0] and rows[30]["spans"] == "" and rows[30]["n_found"] == 2


def test_belief_propagation_is_exact_on_a_tree():
    nodes, cells, seen, near, far = field_of("a1 b2 c3")
    r = np.random.RandomState(0)
    model = (r.randn(pii.CELLS, 6), r.randn(6, 6), r.randn(6, 6))
    odds = np.zeros((3, 6))
    for labels in itertools.product(range(6), repeat=3):
        weight = sum(model[0][cells[i], k] for i, k in enumerate(labels)) + sum(model[1][labels[i], labels[i + 1]] for i in range(2))
        for i, k in enumerate(labels):
            odds[i, k] += np.exp(weight)
    old, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert near.tolist() == [[0, 1], [1, 2]] and not len(far)
        assert np.allclose(pii.marginals(cells, seen, near, far, model), odds / odds.sum(axis=1, keepdims=True), atol=1e-3)
    finally:
        pii.ROUNDS = old


def test_cases_and_fit():
    """The cases of a text by plain reading; a fitted field makes no label likelier than its evidence allows."""
    texts = ["+15215551234 x +15215551234", "1.2.3.4 5.6.7.8", "7 8 9 and 4111111111111111 4111111111111111"]
    for text, want in zip(texts, [(2, 1, 0), (2, 0, 1), (5, 1, 3)], strict=True):
        nodes = field_of(text)[0]
        assert (len(nodes.cells), len(nodes.skip), len(nodes.chain)) == want
    assert field_of(texts[0])[2].tolist() == [4, 4] and not field_of(texts[0])[0].hidden.any()
    assert field_of("+15215551234 x 5551234")[0].hidden.tolist() == [False, True]
    own, along, across = pii.fit(np.zeros((0, 3), np.int64))
    assert not own.any() and not along.any() and (across == pii.SAME * np.diag([0, 1, 1, 1, 1, 1])).all()
    wide = pii.LABELS + 1
    alone = lambda cell: ((cell * wide + pii.UNKNOWN) * wide + pii.UNKNOWN) * wide + pii.UNKNOWN
    own, _, _ = pii.fit(np.array([(alone(5), 3, 900), (alone(5), 0, 100), (alone(900), 0, 10**9)], np.int64))
    assert own[5, 3] > 1 and own[900, 3] < -1 and own.min() >= -pii.AGAINST and own.max() <= pii.FOR


def test_media_round_trip(spark):
    texts = [*ODD, "x" * 192, "x" * 193]
    stored = media.to_media(table(spark, texts)).orderBy("doc_id").collect()
    rows = media.media_columns(table(spark, texts)).orderBy("doc_id").collect()
    for text, s, r in zip(texts, stored, rows, strict=True):
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        with wave.open(__import__("io").BytesIO(bytes(s["media"]))) as of:
            assert of.readframes(of.getnframes()) == padded and of.getsampwidth() == 1
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_sha256"]) == (zlib.crc32(padded[-16:]), hashlib.sha256(bytes(s["media"])).hexdigest())
    assert rows[7]["feature"] == rows[8]["feature"] and rows[1]["feature"] == "" and rows[6]["feature"]
    for text, r in zip(texts, rows, strict=True):
        assert r["feature"] == slow_feature(media.payload(text)[0])


def slow_feature(samples):
    """Frame by frame, cell by cell."""
    signal = [x - 128.0 for x in samples]
    count = 1
    while 256 + (count - 1) * 128 < len(signal):
        count += 1
    signal += [signal[-1]] * (256 + (count - 1) * 128 - len(signal))
    frames = np.array([signal[128 * i : 128 * i + 256] for i in range(count)])
    loud = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * np.hanning(256), axis=1))
    found = [(t, f) for t in range(count) for f in range(2, 129) if loud[t, f] > 1e-3 and loud[t, f] == loud[max(0, t - 1) : t + 2, max(2, f - 8) : f + 9].max()]
    pairs = [(t, (f << 14) | (g << 6) | (u - t)) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 4] if u - t <= 63]
    return ",".join(f"{t:x}:{c:x}" for t, c in sorted(pairs))


def test_media_reads_the_last_samples():
    """Payloads that are no multiple of the hop: the last 64 samples are transformed too."""
    r = np.random.RandomState(3)
    base = r.randint(32, 127, 576).astype(np.uint8)
    made = set()
    for _ in range(50):
        base[-64:] = r.randint(32, 127, 64)
        made.add(tuple(np.concatenate(media.landmarks(base.tobytes())).tolist()))
    assert len(made) > 40


def test_media_blocks_do_not_change_features():
    samples = np.random.RandomState(1).randint(32, 127, 256 * 500).astype(np.uint8).tobytes()
    whole = media.landmarks(samples)
    old, media.FRAMES_AT_ONCE = media.FRAMES_AT_ONCE, 7
    try:
        assert all((a == b).all() for a, b in zip(whole, media.landmarks(samples), strict=True)) and len(whole[0]) > 50
    finally:
        media.FRAMES_AT_ONCE = old


EXTRA = ["á b ́c İSTANBUL ΟΔΟΣ <|endoftext|>x", "12ab's don'T\x85nbsp\xa0x\x1cq\n\t\rz'll 'sab ''re", "½²a_b ª_º\x1f×÷ ÀÖß\xadsoft\x00 ÿ Ÿ", "x" * 500, "a<|x '", "''s's"]


def test_tokenizer_agrees_with_the_library():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path())
    for text in [*EXTRA, *[t for t in ODD if t]] * 2:
        assert mine(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("limits", [(2048, 256, None), (64, 3, 40)])
def test_packing_holds_every_id_once(spark, limits):
    texts = [*ODD, *EXTRA, *[prose(i, 5 + i * 7) for i in range(40)]]
    df = table(spark, texts).withColumn("lead", F.lit(5))
    rows = packing.pack_documents(df, packing.tokenizer_path(), *limits, prompt=F.col("lead"), group_tokens=3000).collect()
    mine = packing.WordTokenizer(packing.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = mine(text or "") + b"\1\0\0\0"
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            assert r["loss_tokens"] == max(0, at + r["length"] - max(at, 5))
            at += r["length"]
        assert at == len(ids) // 4
    for group in sequences.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits[0] and len(group) <= limits[1] and sum(r["loss_tokens"] for r in group) <= (limits[2] or limits[0])
        if limits[1] == 256:
            assert at == 2048 or at & (at - 1) == 0


def test_mixing_matches_its_sql_and_its_rates(spark):
    texts = [prose(i, 20) for i in range(3000)]
    df = table(spark, [*texts, None, "", "twin", "twin"], [*range(3000), None, 3001, 3002, 3002], sources=["big" if i % 3 else "small" for i in range(3001)] + [None, "tiny", "tiny"])
    got = mixing.mix_sources(df.select("doc_id", "text", "lang", "source", "n_chars")).toPandas()
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(mixing.OP6_ORACLE).df()
    assert sorted(got.shuffle_key) == sorted(want.shuffle_key) and len(set(got[got.doc_id < 3000].shuffle_key)) == (got.doc_id < 3000).sum()
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(df, Workspace(spark, "t")).collect()}
    for source, n in (("big", 2000), ("small", 1000)):
        assert abs((got.source == source).sum() / n - rates[source]) < 0.12
    heavy = mixing.mix_sources(df, {"small": 0.99, "big": 0.01}, seed="x").groupBy("source").count().toPandas().set_index("source")["count"]
    assert heavy["small"] / (heavy["small"] + heavy["big"]) > 0.97 and "tiny" not in heavy
    assert mixing.mix_sources(table(spark, ["a b"] * 40, sources=["few"] * 39 + ["one"]), {"few": 0.01, "one": 0.99}).where("source = 'one'").count() > 20


def longest_common(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_patience_diff():
    r = random.Random(2)
    for n in range(400):
        if n % 2:
            a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 9))] for _ in range(2))
        else:  # without repeats it is a longest common subsequence
            a, b = (r.sample(range(14), r.randint(0, 12)) for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
        assert len(got) == longest_common(a, b) if n % 2 == 0 else len(got) <= longest_common(a, b)
    assert linededup.patience([1, 1, 2, 3, 3], [1, 1, 9, 3, 3]) == [(0, 0), (1, 1), (3, 3), (4, 4)]
    assert linededup.patience([7, 1, 5, 1, 8], [6, 1, 5, 1, 9]) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("list_part", [256, 2])
def test_line_dedup_takes_blocks_from_later_documents(spark, list_part):
    block = "\n".join(prose(50 + i, 12) for i in range(3))
    texts = [f"{prose(i, 9)}\n{block}\n{prose(100 + i, 9)}" for i in range(12)] + [None, "", "short\nshort", "short\nshort", block, prose(7, 4)]
    ids = [None, *range(1, len(texts))]
    rows = linededup.line_dedup(table(spark, texts, ids), list_part=list_part).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and by[None]["text"] == texts[0]
    for i in range(1, 12):
        assert by[i]["text"] == f"{prose(i, 9)}\n{prose(100 + i, 9)}" and (by[i]["n_lines"], by[i]["n_removed"]) == (5, 3)
    assert by[12]["text"] is None and by[14]["text"] == by[15]["text"] == "short\nshort" and by[16]["text"] == "" and by[17]["n_removed"] == 0
    kept = linededup.drop_repeated_lines(table(spark, texts, ids), list_part=list_part)
    assert 16 not in {r["doc_id"] for r in kept.collect()} and kept.count() == len(texts) - 1


def slow_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures_and_host_verdicts(spark):
    loop = "a b c d e f g h i j " * 6
    texts = [*ODD, loop, "x #y\n\nx #y\n x #y\n" + prose(3, 30), "a b\x85c " * 30, *[prose(i, 40) for i in range(60)], *["bad"] * 60]
    hosts = ["mix"] * (len(texts) - 120) + ["good"] * 59 + [None] + ["awful"] * 59 + [None]
    rows = quality.quality_rules(table(spark, [*texts, prose(99, 50)], sources=[*hosts, "awful"])).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=False):
        want = slow_measure(text)
        assert tuple(r[m] for m in quality.MEASURES) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert all(r["kept"] for r in rows[len(texts) - 120 : len(texts) - 60]) and not rows[-1]["base_failed"] and not rows[-1]["kept"]
    good = quality.keep_good(table(spark, texts, sources=hosts))
    assert sorted(r["doc_id"] for r in good.collect()) == [r["doc_id"] for r in rows[:-1] if r["kept"]] and good.columns == table(spark, [""]).columns


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate([*ODD, *ODD, prose(4, 20_000)])] + [(None, None, "alone"), (3, "http://h/3", "one")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("size", F.lit("x")).withColumn("sha1", F.lit("y"))
    got = Counter(tuple(r) for r in warc.round_trip(df, archive_bytes=20_000).collect())
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    want = {tuple(None if x is pd.NA or x != x else x for x in r) for r in con.execute(warc.OP9_ORACLE).df().astype(object).itertuples(index=False)}
    plain = Counter((a, b, c, d, e) for a, b, c, d, e in got.elements() if a is not None)
    assert set(plain) == {tuple(int(x) if isinstance(x, float) else x for x in w) for w in want if w[0] is not None}
    assert sum(got.values()) == len(pages) and [r[3] for r in got if r[0] is None] == ["response"]
    assert {r[3] for r in warc.round_trip(df, revisit_bytes=10**9).collect()} == {"response"}


def test_archive_leads_with_its_dictionary():
    records = [f"record {i} {prose(i, 50)}".encode() for i in range(300)]
    for some in (records, records[:1]):
        data = warc.archive(some)
        assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records_of(data)) == some


def test_segmentation_sums_match_enumeration():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    probs = np.random.RandomState(0).rand(6, 2) * 0.3
    model = langid.Segmenter(pieces, probs)

    def slow(word):
        word, total, uses = "▁" + word, np.zeros(2), np.zeros((6, 2))
        for cuts in itertools.product([False, True], repeat=len(word) - 1):
            parts = re.split("\0", "".join(c + ("\0" if x else "") for c, x in zip(word, [*cuts, False], strict=True)))
            if all(p in pieces or len(p) == 1 for p in parts):
                weight = np.prod([probs[pieces[p]] if p in pieces else np.full(2, langid.UNKNOWN_CHAR) for p in parts], axis=0)
                total += weight
                for p in parts:
                    if p in pieces:
                        uses[pieces[p]] += weight
        return np.log(total), uses / total

    words = ["abab", "a", "xab", "bba", ""]
    into = np.zeros((6, 2))
    model.expected(words, np.ones((5, 2)), into)
    assert np.allclose(model.forward(words), [slow(w)[0] for w in words]) and np.allclose(into, sum(slow(w)[1] for w in words))
    assert np.allclose(model.forward_long(words), [slow(w)[0] for w in words])
    logs = np.zeros((6, 2))
    model._expected_long(words, np.ones((5, 2)), logs)
    assert np.allclose(logs, into) and np.isfinite(model.forward_long(["ab" * 3000, "x" * 40])).all()


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = table(spark, [None, "", "123 ...", "z" * 5000]).select(docs.columns)
    rows = langid.identify(docs.unionByName(odd), docs.where(~langid.is_held_out()), langid.vocabulary_path())
    joined = rows.where(langid.is_held_out()).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (joined.lang == joined.lang_pred).mean() > 0.97 and joined.score.between(0, 1).all()
    assert rows.where("lang_pred = 'und' AND score = 0").count() == 3


def test_languages_without_spaces_and_numerals(spark):
    r = random.Random(5)
    han, kana = ["一二三四五六七八九十", "あいうえおかきくけこ"]
    texts = ["".join(r.choices(han, k=300)) for _ in range(30)] + ["".join(r.choices(kana, k=300)) for _ in range(30)]
    docs = table(spark, texts, langs=["zh"] * 30 + ["ja"] * 30)
    counted = {w["word"] for w in langid.word_counts(docs, ["ja", "zh"]).collect()}
    assert counted == set(texts)
    rows = langid.identify(table(spark, ["".join(r.choices(han, k=80)), "".join(r.choices(kana, k=500)), "²", "½ Ⅷ ①", "12_3", "²a"]), docs, langid.vocabulary_path()).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in rows[:5]] == ["zh", "ja", "und", "und", "und"] and rows[5]["lang_pred"] != "und" and rows[2]["score"] == 0


def test_empty_tables(spark):
    none = table(spark, ["x"]).where("false")
    made = [simhash.near_duplicates(none), suffix.remove_repeats(none), pii.personal_data(none), media.media_columns(none), packing.pack_documents(none, packing.tokenizer_path()), mixing.mix_sources(none)]
    made += [linededup.line_dedup(none), quality.quality_rules(none), langid.identify(none, none, langid.vocabulary_path())]
    made.append(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")))
    assert [df.count() for df in made] == [0] * len(made)


def names_of(lines):
    return [hashlib.md5(x.encode()).digest() for x in lines]


@pytest.mark.parametrize("least", [150, None])
def test_line_dedup_agrees_with_all_pairs(spark, least):
    least = least or linededup.MIN_CHARS
    r = random.Random(11)
    x, y, s = "x" * 200, "y" * 200, "s" * 100
    groups = [[[x, "a"], [y, "b"], [y, x], [x, y]], [[x, s, "a"], [x, "q"], [x, s, "z"]]]
    pool = [prose(300 + i, n) for i, n in enumerate([2, 4, 8, 12, 16, 30] * 3)] + [""]
    groups.append([[r.choice(pool) for _ in range(r.randint(1, 8))] for _ in range(60)])
    for group in groups:
        want = []
        for n, lines in enumerate(group):
            gone = {q for before in group[:n] for q in linededup.common_blocks(names_of(before), names_of(lines), list(map(len, lines)), least)}
            gone = linededup.with_blanks(gone, lines)
            want.append("\n".join(t for i, t in enumerate(lines) if i not in gone))
        got = linededup.line_dedup(table(spark, ["\n".join(g) for g in group]), least).orderBy("doc_id").collect()
        assert [g["text"] for g in got] == want


@pytest.mark.parametrize("times", [1, 2, 5])
def test_a_line_repeated_within_documents_goes_with_few_alignments(spark, times):
    """No line is unique in both texts; the first alignments take the line all the same, and no document meets all before it."""
    line = "Subscribe to our newsletter for weekly product updates, or"
    texts = ["\n".join(x for k in range(times) for x in (prose(1000 + 7 * i + k, 3), line)) + "\nend" for i in range(120)]
    work = Workspace(spark, "repeated")
    lines = work.keep(linededup.line_table(table(spark, texts).select("doc_id", "text")), "lines")
    posted = work.keep(linededup.postings(lines), "postings")
    met = linededup.pairs(linededup.shared(posted, work)).count()
    assert met <= 2 * posted.count()
    rows = {r["doc_id"]: r for r in linededup.line_dedup(table(spark, texts)).collect()}
    assert rows[0]["n_removed"] == 0 and all(rows[i]["n_removed"] >= times and line not in rows[i]["text"] for i in range(1, 120))


def test_blank_lines_go_with_the_lines_around_them():
    lines = ["", "a", "", "", "b", "", "c", "", "d", ""]
    assert linededup.with_blanks(set(), lines) == set()
    assert linededup.with_blanks({1, 4}, lines) == {0, 1, 2, 3, 4}
    assert linededup.with_blanks({6}, lines) == {6} and linededup.with_blanks({8}, lines) == {8, 9}
    assert linededup.with_blanks({1, 4, 6, 8}, lines) == set(range(10))


def test_counted_lines_are_aligned():
    a, b = list("pxqxryz"), list("mxnxoxz")
    assert linededup.patience(a, b) == [(1, 1), (3, 3), (6, 6)]
    blank = linededup.BLANK
    assert linededup.patience([blank, blank, b"l", b"l", b"p"], [b"l", b"l", blank, blank, b"q"]) == [(2, 0), (3, 1)]


def test_line_dedup_takes_single_sentences(spark):
    sentence = "All of this site's pages may be copied freely."
    texts = [f"{prose(400 + i, 9)}\n{sentence}\nnext\n{prose(500 + i, 9)}" for i in range(6)]
    rows = {r["doc_id"]: r for r in linededup.line_dedup(table(spark, texts)).collect()}
    assert sentence in rows[0]["text"] and not any(sentence in rows[i]["text"] for i in range(1, 6))


def test_line_dedup_on_given_tables_agrees_with_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lines = {r["doc_id"]: [x.strip(" \t\n\r\x0b\x0c") for x in r["text"].split("\n")] for r in docs.where("text IS NOT NULL").collect()}
    got = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs).collect()}
    removed = 0
    for later, mine in lines.items():
        gone = {q for earlier, before in lines.items() if earlier < later and set(before) & set(mine) - {""} for q in linededup.common_blocks(names_of(before), names_of(mine), list(map(len, mine)))}
        want = Counter(x for q, x in enumerate(mine) if q not in gone and x)
        assert Counter(x.strip(" \t\n\r\x0b\x0c") for x in got[later].split("\n") if x.strip(" \t\n\r\x0b\x0c")) == want, later
        removed += len(gone)
    assert removed > 20


def test_packing_of_given_tables(spark):
    """The registered query: every id once, no sequence padded, and the documents' ids as the library has them."""
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    plain, sequences, at = Tokenizer.from_file(packing.tokenizer_path()), defaultdict(int), defaultdict(int)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in texts.items()}
    rows = packing.op5_packing(spark, sf_dir).collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * at[r["doc_id"]]])
        sequences[r["sequence_id"]] += r["length"]
    assert {i: 4 * n for i, n in at.items()} == {i: len(x) for i, x in ids.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, -1)], "k string, i long")
    unique = rows.where("k IS NOT NULL AND k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least"))
    for how in ("inner", "left"):
        got = Counter(tuple(r) for r in common.join_unique(rows, unique, "k", "n", "i", how).select("k", "i", "least").collect())
        assert got == Counter(tuple(r) for r in rows.join(unique, "k", how).select("k", "i", "least").collect())
