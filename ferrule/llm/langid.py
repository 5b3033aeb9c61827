"""Operator 10: language identification by unigram models whose segmentations are summed out.

The vocabulary is a fixed public one. A word's probability in a language is the sum, over all ways to cut it
into pieces, of the product of the pieces' probabilities, computed by the forward algorithm; a text's is the
product over its words. Piece probabilities are learned by expectation maximisation over word counts: Spark
counts the words of all training texts by language, and each round spreads the distinct words over tasks,
runs forward and backward passes, and adds up expected piece counts. Long words, such as sentences of a language
written without spaces, are summed in the same way with logarithms, as their probabilities leave a float's range.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, table

UNKNOWN_LANGUAGE = "und"
ROUNDS = 2
#: Expected counts added to every piece of a language, and the probability of a character outside the vocabulary.
SMOOTH = 0.1
UNKNOWN_CHAR = 1e-7
#: Distinct words that a worker holds at once, and the longest that it remembers and sums without logarithms.
HELD_WORDS, HELD_CHARS = 400_000, 32
WORDS_AT_ONCE = 4000
#: Characters of texts that a task counts at once.
HELD_TEXT = 1 << 26
#: Positions x languages of long words that are summed at once; a single word may have more.
CELLS_AT_ONCE = 1 << 20
MARK, LEAST = "▁", 1e-300
#: Candidates for letters; numerals such as ² and Ⅷ are among them and not letters.
WORDLIKE = re.compile(r"[^\W\d_]")


#: Multiplier of the 64-bit hashes that find pieces, and bits of the table that says which hashes may be a piece's.
HASH_ODD, MAYBE_BITS = np.uint64(0x9E3779B97F4A7C15), 21


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def vocabulary(path: str) -> dict[str, int]:
    """Ordinary pieces of a sentencepiece file, numbered from 0."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: i for i, p in enumerate(dict.fromkeys(pieces))}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _slot(hashed: np.ndarray) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(32))) * HASH_ODD) >> np.uint64(64 - MAYBE_BITS)


@functools.cache
def _seed(n: int) -> np.uint64:
    """What a seed of n comes to in the hash of n characters."""
    return np.uint64(n * pow(int(HASH_ODD), n, 1 << 64) % (1 << 64))


class Arcs:
    """The arcs of some words' lattices, word by word: word, begin, to and piece; and the words' marked lengths."""

    def __init__(self, word, begin, to, piece, sizes):
        self.word, self.begin, self.to, self.piece, self.sizes = word, begin, to, piece, sizes

    def steps(self, position: np.ndarray, down: bool = False):
        """(position, arcs there, the first of each word among them), upwards or down."""
        key = position.max(initial=0) - position if down else position
        order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
        at, word = position[order], self.word[order]
        other = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        fresh = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        ends = [*other[1:].tolist(), len(at)]
        cuts = [0, *np.searchsorted(fresh, ends).tolist()]
        for n, (lo, hi) in enumerate(zip(other.tolist(), ends, strict=True)):
            yield int(at[lo]), order[lo:hi], fresh[cuts[n] : cuts[n + 1]] - lo


class Segmenter:
    """Sums over segmentations of marked words, for all languages at once. Pieces are found by 64-bit hashes of a word's parts."""

    def __init__(self, pieces: dict[str, int], probs: np.ndarray):
        self.pieces, self.langs = pieces, probs.shape[1]
        self.probs = np.vstack([probs, np.full((1, self.langs), UNKNOWN_CHAR)])  # the last: a character outside the vocabulary
        self.lengths = np.array([*map(len, pieces), 1])
        self.hashes: list[tuple[np.ndarray, np.ndarray]] = []  # by length: sorted hashes and their pieces
        self.maybe = np.zeros(1 << MAYBE_BITS, bool)
        for length in range(1, max(map(len, pieces), default=0) + 1):
            mine = np.array([k for p, k in pieces.items() if len(p) == length], np.int64)
            text = "".join(p for p in pieces if len(p) == length)
            hashed = np.full(len(mine), length, np.uint64)
            for column in _codes(text).reshape(len(mine), length).T:
                hashed = hashed * HASH_ODD + column
            order = np.argsort(hashed)
            self.hashes.append((hashed[order], mine[order]))
            self.maybe[_slot(hashed)] = True

    def arcs(self, words: list[str]) -> Arcs:
        joined = MARK + MARK.join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(sizes) - sizes
        codes, rest = _codes(joined), np.repeat(begins + sizes, sizes) - np.arange(len(joined))
        at, hashed, alone = np.arange(len(joined)), np.zeros(len(joined), np.uint64), np.zeros(len(joined), bool)
        starts, pieces = [], []
        for length, (known, mine) in enumerate(self.hashes, 1):
            if length > 1:
                inside = rest[at] >= length
                at, hashed = at[inside], hashed[inside]
            hashed = hashed * HASH_ODD + codes[at + (length - 1)]
            marked = hashed + _seed(length)
            some = np.flatnonzero(self.maybe[_slot(marked)])
            if len(some) and len(known):
                place = np.minimum(np.searchsorted(known, marked[some]), len(known) - 1)
                same = known[place] == marked[some]
                starts.append(at[some[same]])
                pieces.append(mine[place[same]])
                if length == 1:
                    alone[starts[0]] = True
        other = np.flatnonzero(~alone)
        start = np.concatenate([*starts, other])
        piece = np.concatenate([*pieces, np.full(len(other), len(self.pieces))])
        order = np.argsort(start, kind="stable")
        start, piece = start[order], piece[order]
        word = np.repeat(np.arange(len(words)), sizes)[start]
        begin = start - begins[word]
        return Arcs(word, begin, begin + self.lengths[piece], piece, sizes)

    def _forward(self, arcs: Arcs) -> np.ndarray:
        """Forward sums: word x position x language."""
        sums = np.zeros((len(arcs.sizes), int(arcs.sizes.max()) + 1, self.langs))
        sums[:, 0] = 1.0
        weight = self.probs[arcs.piece]
        for at, order, first in arcs.steps(arcs.to):
            word = arcs.word[order]
            made = sums[word, arcs.begin[order]] * weight[order]
            sums[word[first], at] = np.add.reduceat(made, first, axis=0)
        return sums

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        arcs = self.arcs(words)
        return np.log(np.maximum(self._forward(arcs)[np.arange(len(words)), arcs.sizes], LEAST))

    def _forward_logs(self, arcs: Arcs) -> np.ndarray:
        sums = np.full((len(arcs.sizes), int(arcs.sizes.max()) + 1, self.langs), -np.inf)
        sums[:, 0] = 0.0
        weight = np.log(self.probs)[arcs.piece]
        for at, order, first in arcs.steps(arcs.to):
            word = arcs.word[order]
            sums[word[first], at] = np.logaddexp.reduceat(sums[word, arcs.begin[order]] + weight[order], first, axis=0)
        return sums

    def forward_long(self, words: list[str]) -> np.ndarray:
        """The same as forward for words of any length."""
        out = np.zeros((len(words), self.langs))
        for some in self._long_batches(words):
            arcs = self.arcs([words[i] for i in some])
            out[some] = self._forward_logs(arcs)[np.arange(len(some)), arcs.sizes]
        return out

    def _long_batches(self, words: list[str]):
        """Places of words of like length, of CELLS_AT_ONCE cells together or one word."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * (len(words[order[n]]) + 2) * self.langs <= CELLS_AT_ONCE:
                n += 1
            yield order[:n]
            order = order[n:]

    def expected(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        """Add the expected number of uses of each piece, for words seen so often in each language."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero(lengths <= HELD_CHARS)
        short = short[np.argsort(lengths[short], kind="stable")]  # like lengths together
        for lo in range(0, len(short), WORDS_AT_ONCE):
            some = short[lo : lo + WORDS_AT_ONCE].tolist()
            self._expected([words[i] for i in some], counts[some], into)
        long = np.flatnonzero(lengths > HELD_CHARS).tolist()
        for some in self._long_batches([words[i] for i in long]):
            some = [long[i] for i in some]
            self._expected_long([words[i] for i in some], counts[some], into)

    def _expected(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        arcs = self.arcs(words)
        sums = self._forward(arcs)
        back = np.zeros_like(sums)
        ends = np.arange(len(words)), arcs.sizes
        back[ends] = counts / np.maximum(sums[ends], LEAST)
        weight = self.probs[arcs.piece]
        for at, order, first in arcs.steps(arcs.begin, down=True):
            word = arcs.word[order]
            back[word[first], at] += np.add.reduceat(back[word, arcs.to[order]] * weight[order], first, axis=0)
        self._add(arcs.piece, sums[arcs.word, arcs.begin] * weight * back[arcs.word, arcs.to], into)

    def _expected_long(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        arcs = self.arcs(words)
        sums = self._forward_logs(arcs)
        back = np.full_like(sums, -np.inf)
        ends = np.arange(len(words)), arcs.sizes
        back[ends] = np.log(np.maximum(counts, LEAST)) - sums[ends]
        weight = np.log(self.probs)[arcs.piece]
        for at, order, first in arcs.steps(arcs.begin, down=True):
            word = arcs.word[order]
            back[word[first], at] = np.logaddexp.reduceat(back[word, arcs.to[order]] + weight[order], first, axis=0)
        self._add(arcs.piece, np.exp(sums[arcs.word, arcs.begin] + weight + back[arcs.word, arcs.to]), into)

    def _add(self, piece: np.ndarray, uses: np.ndarray, into: np.ndarray) -> None:
        for lang in range(self.langs):
            into[:, lang] += np.bincount(piece, uses[:, lang], len(into) + 1)[:-1]


class WordScores:
    """Log probabilities of texts from those of their words; words met first are remembered, up to HELD_WORDS."""

    def __init__(self, segmenter: Segmenter):
        self.segmenter, self.rows, self.logs = segmenter, {}, np.zeros((1 << 12, segmenter.langs))

    def totals(self, texts: list[list[str] | None]):
        """(position, log probabilities) of every text that has words."""
        rows, kept = self.rows, len(self.rows)
        new = [w for w in set().union(*filter(None, texts)) if w not in rows]
        long = [w for w in new if len(w) > HELD_CHARS]
        new = sorted((w for w in new if len(w) <= HELD_CHARS), key=len)  # like lengths together
        far = dict(zip(long, self.segmenter.forward_long(long), strict=True))
        while len(self.logs) < kept + len(new):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        for lo in range(0, len(new), WORDS_AT_ONCE):
            some = new[lo : lo + WORDS_AT_ONCE]
            at = len(rows)
            self.logs[at : at + len(some)] = self.segmenter.forward(some)
            rows.update(zip(some, range(at, at + len(some)), strict=True))
        for n, words in enumerate(texts):
            if words is not None:
                total = np.zeros(self.segmenter.langs)
                if far:
                    total += sum((far[w] for w in words if w in far), np.zeros(self.segmenter.langs))
                    words = [w for w in words if w not in far]
                yield n, total + self.logs.take(np.fromiter(map(rows.__getitem__, words), np.int64, len(words)), axis=0).sum(axis=0)
        for w in new[max(0, HELD_WORDS - kept) :]:
            del rows[w]


_scorers: dict[str, WordScores] = {}


def _word_scores(token: str, model) -> WordScores:
    """One a worker and run, so that its memory of words serves all tasks."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = WordScores(Segmenter(*model.value))
    return _scorers[token]


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(word, counts): how often each word occurs in each language's texts."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        held: dict[int, Counter] = {i: Counter() for i in number.values()}
        size = 0

        def out():
            for i, c in held.items():
                if c:
                    yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([i] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "lang", "n"])
                    c.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[number[lang]].update(text.split())
                size += len(text)
            if sum(map(len, held.values())) > HELD_WORDS or size > HELD_TEXT:
                yield from out()
                size = 0
        yield from out()

    counted = docs.select("lang", "text").mapInArrow(run, "word string, lang int, n long")
    return counted.groupBy("word").agg(F.array(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)) for i in range(len(langs))]).alias("counts"))


def train(docs: DataFrame, pieces: dict[str, int], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their share of texts, and piece probabilities (pieces x languages); bounded by the vocabulary."""
    spark = docs.sparkSession
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = labelled.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in found)
    size, wide = len(pieces), len(langs)
    if not langs:
        return [], np.zeros(0), np.zeros((size, 0))
    shares = np.array([next(r["count"] for r in found if r["lang"] == x) for x in langs], float)
    words = Workspace(spark, "langid").keep(word_counts(labelled, langs), "words")
    probs = np.full((size, wide), 1.0 / size)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(probs)

        def run(batches, model=model):
            segmenter, into = Segmenter(pieces, model.value), np.zeros((size, wide))
            for batch in batches:
                counts = np.array(batch.column(1).flatten(), float).reshape(-1, wide)
                segmenter.expected(batch.column(0).to_pylist(), counts, into)
            used = np.flatnonzero(into.any(axis=1))
            if len(used):
                yield pa.record_batch([pa.array(used, pa.int32()), pa.array(into[used].tolist(), pa.list_(pa.float64()))], ["piece", "uses"])

        uses = words.mapInArrow(run, "piece int, uses array<double>").groupBy("piece").agg(*[F.sum(F.col("uses")[i]).alias(f"u{i}") for i in range(wide)])
        total = np.full((size, wide), SMOOTH)
        for r in uses.collect():  # at most one row for each piece of the vocabulary
            total[r["piece"]] += [r[f"u{i}"] for i in range(wide)]
        probs = total / total.sum(axis=0)
        model.unpersist()
    return langs, shares / shares.sum(), probs


def identify(docs: DataFrame, train_on: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; score is the predicted language's posterior.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.
    Ties go to the first language by name. Repeated rows are scored alike, a null doc_id stays null (op10 takes it as
    not held out), empty tables give no rows, other columns are ignored. Words are cut at white space; a word of any
    length is counted and summed whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = vocabulary(vocabulary_path)
    langs, shares, probs = train(train_on, pieces, rounds)
    model = spark.sparkContext.broadcast((pieces, probs))
    start = np.log(shares)

    token = uuid.uuid4().hex

    def run(batches):
        scores = _word_scores(token, model) if langs else None
        for batch in batches:
            texts = [t.split() if langs and t and has_letter(t) else None for t in batch.column(1).to_pylist()]
            totals = scores.totals(texts) if langs else []
            preds, odds = [UNKNOWN_LANGUAGE] * len(texts), np.zeros(len(texts))
            for n, total in totals:
                total = start + total
                weight = np.exp(total - total.max())
                best = int(weight.argmax())
                preds[n], odds[n] = langs[best], weight[best] / weight.sum()
            yield pa.record_batch([batch.column(0), pa.array(preds, pa.string()), pa.array(odds)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs.where(~is_held_out()), vocabulary_path()).withColumn("held_out", is_held_out()).select("doc_id", "held_out", "lang_pred", "score")
