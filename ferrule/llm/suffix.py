"""Operator 2: removal of long repeated byte strings through a logarithmic family of sparse suffix arrays.

Only some suffixes are indexed. Of the grams of GRAM bytes in a string of LENGTH bytes, the one with the
least hash (the first, if tied) is the string's anchor, so equal strings have equal anchors at equal
offsets. A batch's suffix array is the sorted table of its anchors: a 64-bit code of the suffix's first
GRAM bytes, the text and the position. A new batch's array is merge-scanned against every level of the
family, which yields the codes that begin a long match; arrays of equal size are then merged into a level
of twice the size. A code that is met but once cannot begin a repeat.

For the other anchors the text around them is fetched, and all bytes are compared: the suffixes of a code
are sorted, as are the prefixes before them read backwards, with the lengths that neighbours share. For an
offset of the anchor, strings of LENGTH bytes are equal exactly if neither array has a shorter shared
length between them. Codes with more suffixes than one task should hold are cut into parts, and strings
that a part has but once are compared across parts by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, join_unique, table

LENGTH = 200
GRAM = 64
#: Batches that a one-off run adds to the family.
BATCHES = 3
#: Suffixes of one code that a task compares at once.
PART = 16_384
#: String starts that are hashed at once, and suffixes compared at once.
SLICE, HELD = 1 << 18, 16_384
#: Texts that a task remembers, so as to take equal ones once.
HELD_TEXTS = 1 << 20

_mix = np.random.RandomState(20_200).randint(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_odd = np.array([2_654_435_761, 2_246_822_519, 3_266_489_917, 668_265_263, 374_761_393, 2_869_860_233], np.uint32)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the gram (a power of two) at each position, by doubling."""
    h, width = _mix[data], 1
    for odd in _odd[: gram.bit_length() - 1]:
        h = h[:-width] * odd + h[width:]
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(2_246_822_519)
    return h ^ (h >> np.uint32(13))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of so many."""
    n, step = len(keys) - width + 1, 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[:n], keys[width - step : width - step + n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text, position, first and last string start of every anchor of the texts, and its code."""
    out = []
    pieces, held = [], 0
    for n, raw in enumerate(texts):
        for at in range(0, len(raw) - length + 1, SLICE):
            pieces.append((n, at, raw[at : at + SLICE + length - 1]))
            held += len(pieces[-1][2])
            if held >= SLICE:
                out.append(_anchors(pieces, length, gram))
                pieces, held = [], 0
    if pieces:
        out.append(_anchors(pieces, length, gram))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(5))


def _anchors(pieces, length: int, gram: int):
    joined = b"".join(p for _, _, p in pieces)
    sizes = np.array([len(p) for _, _, p in pieces])
    begins = np.cumsum(sizes) - sizes
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram).astype(np.uint64)
    least = sliding_least((hashes << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes - length + 1)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1) + begins[piece]
    anchor = at[start]
    first = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(piece, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    shift = np.array([a for _, a, _ in pieces])[piece[first]] - begins[piece[first]]
    digest, where = xxhash.xxh64_intdigest, anchor[first].tolist()
    codes = np.array([digest(joined[a : a + gram]) for a in where], np.uint64).view(np.int64)
    text = np.array([n for n, _, _ in pieces])[piece[first]]
    return text, anchor[first] + shift, start[first] + shift, start[last] + shift, codes


def _long_texts(docs: DataFrame, length: int) -> DataFrame:
    """(key, more, text) of the texts that have a string: two 64-bit hashes name a text."""
    return docs.where(F.octet_length("text") >= length).select(F.xxhash64("text").alias("key"), F.xxhash64(F.lit("more"), "text").alias("more"), "text")


def suffix_array(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(code, key, more, at, first, last): the sparse suffix array of a batch, sorted within partitions.

    key and more name the text, at is the suffix's position, and first to last are the starts of the strings it
    anchors. A task takes equal texts once; what several tasks took is reduced when the array is sorted.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            names, texts = [], []
            for name, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    texts.append(text.encode())
            if len(seen) > HELD_TEXTS:
                seen.clear()
            text, at, first, last, codes = anchors(texts, length, gram)
            names = np.array(names, np.int64).reshape(-1, 2)[text]
            yield pa.record_batch(
                [pa.array(codes), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(at.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                ["code", "key", "more", "at", "first", "last"],
            )

    bounded_batches(docs.sparkSession)
    return _sorted(_long_texts(docs, length).mapInArrow(run, "code long, key long, more long, at int, first int, last int"))


def _sorted(suffixes: DataFrame) -> DataFrame:
    """Each suffix once, sorted; dealt by code, text and position, so that a code that very many suffixes share fills no task."""
    return suffixes.repartition("code", "key", "at").dropDuplicates().sortWithinPartitions("code", "key", "at")


class Family:
    """Levels of suffix arrays, each twice as large as the one below, kept as tables in the shared folder."""

    def __init__(self, work: Workspace):
        self.work = work
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.matched: list[DataFrame] = []

    def add(self, array: DataFrame) -> None:
        """Merge-scan a new array against every level for codes that begin a long match, then insert it."""
        rank, (where, now) = 0, self.work.write(array, "array")
        counts = now.groupBy("code").agg(F.count("*").alias("n"))
        mine = counts.select("code")
        found = counts.where("n > 1").select("code")
        for _, _, level in self.levels:
            found = found.unionByName(level.select("code").distinct().join(mine, "code", "left_semi"))
        self.matched.append(self.work.keep(found.distinct(), "matched"))
        while self.levels and self.levels[-1][0] == rank:
            _, below, level = self.levels.pop()
            after, now = self.work.write(_sorted(level.unionByName(now)), "level")
            self.work.drop(where)
            self.work.drop(below)
            rank, where = rank + 1, after
        self.levels.append((rank, where, now))
        self.work.release()

    def candidates(self, part: int = PART) -> DataFrame:
        """The suffixes whose code begins a match, with the number of parts that its suffixes are cut into."""
        codes = self.matched[0]
        for more in self.matched[1:]:
            codes = codes.unionByName(more)
        suffixes = self.levels[0][2]
        for _, _, level in self.levels[1:]:
            suffixes = suffixes.unionByName(level)
        sizes = suffixes.groupBy("code").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).join(codes.distinct(), "code", "left_semi")
        return suffixes.join(self.work.keep(sizes, "sizes").hint("merge"), "code")

    def drop(self) -> None:
        """Delete the levels of a one-off run."""
        for _, where, _ in self.levels:
            self.work.drop(where)


def by_text(candidates: DataFrame) -> DataFrame:
    """(key, more, suffixes): the candidates of each text; as many as the text has anchors at most."""
    return candidates.groupBy("key", "more").agg(F.collect_list(F.struct("code", "at", "first", "last", "parts")).alias("suffixes"))


def segments(docs: DataFrame, lists: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(code, part, parts, doc, at, first, bytes) for each distinct text: the text of all strings that a candidate suffix anchors; doc is the text's SHA-256."""
    long = _long_texts(docs, length).groupBy("key", "more").agg(F.first("text").alias("text"))  # copies leave before the shuffle
    names = ["code", "part", "parts", "doc", "at", "first", "bytes"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.diff(lists.offsets.to_numpy()).cumsum()
            code, at, first, last, parts = (c.to_numpy() for c in lists.flatten().flatten())
            rows, size, low = [], 0, 0
            for text, high in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                span, low = range(low, high), high
                raw = text.encode()
                doc = hashlib.sha256(raw).digest()
                for i in span:
                    a, f, n = int(at[i]), int(first[i]), int(parts[i])
                    part = xxhash.xxh32_intdigest(doc + a.to_bytes(8, "little")) % n if n > 1 else 0
                    rows.append((int(code[i]), part, n, doc, a, f, raw[f : int(last[i]) + length]))
                    size += len(rows[-1][-1])
                if size > 1 << 22:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return long.join(lists.hint("merge"), ["key", "more"]).select("text", "suffixes").mapInArrow(run, "code long, part int, parts int, doc binary, at int, first int, bytes binary")


def shared(groups: np.ndarray, rows: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of fixed-width rows within their groups, and the length that each shares with the one before (-1: another group)."""
    n = len(groups)
    keys = np.concatenate([groups.astype(">u4").view(np.uint8).reshape(n, 4), np.frombuffer(rows, np.uint8).reshape(n, width)], axis=1)
    order = np.argsort(np.ascontiguousarray(keys).view(f"V{width + 4}").ravel().view(f"S{width + 4}"), kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    length = np.where(same.all(axis=1), width + 4, same.argmin(axis=1)) - 4
    return order, np.concatenate([[-1], np.where(length < 0, -1, length)])


def repeated(groups: np.ndarray, split: np.ndarray, left: np.ndarray, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """For each suffix and anchor offset: is the string repeated in the group; and for split groups which strings it has but once, or stand for their like.

    left is the anchor's place in each text. Returns three arrays of suffixes x offsets.
    """
    n, wide = len(texts), length - gram
    right_order, right = shared(groups, b"".join([t[a : a + length].ljust(length, b"\0") for t, a in zip(texts, left.tolist(), strict=True)]), length)
    left_order, back = shared(groups, b"".join([t[:a][::-1].ljust(wide, b"\0") for t, a in zip(texts, left.tolist(), strict=True)]), wide)
    most, least = left, left - (np.array([len(t) for t in texts]) - length)
    twice, once, stands = (np.zeros((n, wide + 1), bool) for _ in range(3))
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(least.min()), int(most.max()) + 1):
        there = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(there):
            continue
        by_right[right_order] = np.cumsum(right < length - offset)
        by_left[left_order] = np.cumsum(back < offset)
        key = by_right[there] * (n + 1) + by_left[there]
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        number = np.cumsum(fresh) - 1
        many = np.bincount(number)[number] > 1
        twice[there[order[many]], offset] = True
        if split.any():
            mine = split[there[order]]
            once[there[order[mine & ~many]], offset] = True
            stands[there[order[mine & many & fresh]], offset] = True
    return twice, once, stands


def matches(parts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, first, last, digest): starts of repeated strings; with a digest, a string that a part of its code has but once (doc null: has several times)."""
    names, types = ["doc", "first", "last", "digest"], [pa.binary(), pa.int32(), pa.int32(), pa.binary()]

    def compare(table: pa.Table):
        code, part = table["code"].to_numpy(), table["part"].to_numpy()
        doc, at, first, texts = (table[c].to_pylist() for c in ("doc", "at", "first", "bytes"))
        groups = np.cumsum((np.diff(code, prepend=code[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0))
        keep = list({(g, d, a, f): i for i, (g, d, a, f) in enumerate(zip(groups.tolist(), doc, at, first, strict=True))}.values())
        size = np.bincount(groups[keep], minlength=int(groups[-1]) + 1)
        split = table["parts"].to_numpy() > 1
        keep = [i for i in keep if size[groups[i]] > 1 or split[i]]
        if not keep:
            return None
        rows = np.array(keep)
        at, first = np.array(at)[rows], np.array(first)[rows]
        twice, once, stands = repeated(groups[rows], split[rows], at - first, [texts[i] for i in keep], length, gram)
        edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        out = [(doc[keep[m]], a, b, None) for m, a, b in zip(who.tolist(), (at[who] - high).tolist(), (at[who] - low).tolist(), strict=True)]
        for flags, named in ((once, True), (stands, False)):
            for m, offset in zip(*[x.tolist() for x in np.nonzero(flags)], strict=True):
                start = int(at[m]) - offset
                begin = start - int(first[m])
                digest = hashlib.sha256(texts[keep[m]][begin : begin + length]).digest()[:16]
                out.append((doc[keep[m]] if named else None, start, start, digest))
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names) if out else None

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= HELD:
                whole = pa.Table.from_batches(held)
                code, part = whole["code"].to_numpy(), whole["part"].to_numpy()
                edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(part) != 0))
                if not len(edges):
                    continue
                cut = int(edges[-1]) + 1
                made = compare(whole.slice(0, cut))
                if made is not None:
                    yield made
                held, rows = whole.slice(cut).to_batches(), len(whole) - cut
        if rows:
            made = compare(pa.Table.from_batches(held))
            if made is not None:
                yield made

    return parts.repartition("code", "part").sortWithinPartitions("code", "part").mapInArrow(run, "doc binary, first int, last int, digest binary")


def repeated_starts(docs: DataFrame, work: Workspace, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, part: int = PART) -> DataFrame:
    """(doc, first, last): runs of starts of strings of ``length`` bytes that start anywhere else in another text or place."""
    family = Family(work)
    for batch in range(batches):
        family.add(suffix_array(docs.where(F.pmod(F.xxhash64("text"), F.lit(batches)) == batch), length, gram))
    listed, lists = work.write(by_text(family.candidates(part)), "candidates")
    family.drop()
    work.release()
    placed, around = work.write(segments(docs, lists, length, gram), "segments")
    work.drop(listed)
    work.release()
    found = work.keep(matches(around, length, gram), "matches")
    work.drop(placed)
    work.release()
    across = found.where("digest IS NOT NULL")
    again = across.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return found.where("digest IS NULL").unionByName(across.where("doc IS NOT NULL").join(again, "digest", "left_semi").select(found.columns)).drop("digest")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes) for every row.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else, in the same text or
    another. Null texts are empty. Equal texts are found by digest and go whole if long enough, so repeated rows
    do too. Texts shorter than ``length`` stay. A null doc_id stays null; other columns are ignored; an empty table
    gives no rows.
    """
    if gram & (gram - 1) or not 1 <= gram <= min(length, 64):
        raise ValueError("gram must be a power of two, at most 64 and at most length")
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "suffix")
    mine = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    starts = repeated_starts(mine.select("text"), work, length, gram, batches, part)
    named = mine.withColumn("doc", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    copies = named.where(F.octet_length("text") >= length).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    whole = copies.select("doc", F.lit(0).alias("first"), F.lit((1 << 31) - 1).alias("last"), "n")
    marks = starts.withColumn("n", F.lit(1).cast("long")).unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"), F.max("n").alias("n"))
    marks = work.keep(marks, "marks")
    work.release()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.encode()
                removed = _merged(runs.values, len(raw), length) if runs.is_valid else []
                parts, at = [], 0
                for a, b in removed:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                spans.append(len(removed))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names)

    joined = join_unique(named, marks, "doc", "n", "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _merged(runs: pa.StructArray, size: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by runs of starts, by start; touching ones are one."""
    first, last = (c.to_numpy().astype(np.int64) for c in runs.flatten())
    order = np.argsort(first, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(first[order].tolist(), np.minimum(last[order] + length, size).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
