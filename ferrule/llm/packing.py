"""Operator 5: vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Within a group of documents (one
task's, of bounded tokens and documents), the open sequence takes the piece whose demands, as shares of the
limits, have the largest dot product with what is left of each limit. When no whole piece fits, the longest
one is cut to fill the rest. A group's last tokens, too few for a full sequence, go to sequences of a power
of two tokens, so they need no padding. Groups are packed where they are read: nothing is shuffled.
"""

from __future__ import annotations

import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
END_ID = 1
GROUP_TOKENS, GROUP_DOCS = 1 << 20, 4096
#: Entries of the word cache of a worker, and the longest word that enters it.
CACHE_WORDS, CACHE_CHARS = 400_000, 64


#: Letters, numbers and white space of Latin-1 as the vocabulary's pre-tokenizer classes them; fixed values.
LETTERS, NUMBERS, BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
PARTS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^{BLANKS}{LETTERS}{NUMBERS}]+")


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Latin-1 texts are lower-cased and cut as the vocabulary's pre-tokenizer does, and a part's ids are
    remembered; parts not yet seen are encoded together, and told apart by the ids that end a word. In other
    texts the words between ASCII white space are encoded, which the pre-tokenizer never joins across.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __call__(self, text: str) -> bytes:
        if "<|" not in text and _is_latin(text):
            parts, coded = PARTS.findall(text.lower()), self._parts
        else:
            parts, coded = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), self._words
        known, later = self.known, None
        if new := [w for w in dict.fromkeys(parts) if w not in known]:
            made = coded(new)
            room = CACHE_WORDS - len(known)
            if room >= len(new) and all(len(w) <= CACHE_CHARS for w in new):
                known.update(made)
            else:
                kept = [w for w in new if len(w) <= CACHE_CHARS][: max(0, room)]
                known.update({w: made[w] for w in kept})
                later = made
        if later is None:
            return b"".join(map(known.__getitem__, parts))
        return b"".join([known[w] if w in known else later[w] for w in parts])

    def _parts(self, new: list[str]) -> dict[str, bytes]:
        ids = self._encode(" ".join(new))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(new):
            return self._words(new)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return {w: raw[a:b] for w, a, b in zip(new, at[:-1], at[1:], strict=True)}

    def _words(self, new: list[str]) -> dict[str, bytes]:
        return {w: self._encode(w).tobytes() for w in new}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # without offsets


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One a worker, so that its memory of words serves all tasks."""
    return WordTokenizer(path)


def pack(sizes: list[int], prompts: list[int], max_tokens: int, max_segments: int, max_loss: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items of given tokens, of which the first few (prompts) bear no loss."""
    out, sequence = [], 0
    start = np.zeros(len(sizes), np.int64)
    left = np.array(sizes, np.int64)
    prompt = np.array(prompts, np.int64)

    def loss(i, n):
        return np.maximum(0, start[i] + n - np.maximum(start[i], prompt[i]))

    while True:
        rest = int(left.sum())
        if not rest:
            return out
        room = max_tokens if rest >= max_tokens else 1 << (rest.bit_length() - 1)
        limits = np.array([room, max_segments, max_loss], np.float64)
        used = np.zeros(3, np.int64)
        live = np.flatnonzero(left)
        tokens, bears = left[live], loss(live, left[live])
        demand = np.stack([tokens, np.ones(len(live), np.int64), bears]) / limits[:, None]
        free = np.ones(len(live), bool)
        while used[0] < room and used[1] < max_segments:
            fits = free & (tokens <= room - used[0]) & (bears <= max_loss - used[2])
            if fits.any():
                worth = np.where(fits, (1 - used / limits) @ demand, -1.0)
                at = int(worth.argmax())
                i, n = live[at], int(tokens[at])
            else:
                at = int(np.where(free, tokens, 0).argmax())
                i, n = live[at], room - int(used[0])
                n = min(n, int(tokens[at]), int(max(0, prompt[i] - start[i]) + max_loss - used[2])) if free[at] else 0
                if n <= 0:
                    break
            used += (n, 1, int(loss(i, n)))
            out.append((int(i), int(start[i]), n, sequence, int(used[0]) - n))
            start[i] += n
            left[i] -= n
            free[at] = False
        sequence += 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    prompt: Column | None = None,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``prompt`` gives the leading tokens of a document that bear no loss (default none). A null or empty text
    has the end id alone. Repeated rows are packed as documents of their own, a null doc_id stays null; other columns are ignored.
    Sequences are numbered within a task, whose number stands in the upper bits. An empty table gives no rows.
    """
    limit = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, limit) < 1:
        raise ValueError("limits must be positive")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def close(group, base):
        whole = [len(b) // 4 for _, b, _ in group]
        pieces, n = [], 0
        for i, tokens in enumerate(whole):  # full sequences straight from long documents
            if limit >= max_tokens:
                for a in range(0, tokens - tokens % max_tokens, max_tokens):
                    pieces.append((i, a, max_tokens, n, 0))
                    n += 1
        done = [w - w % max_tokens if limit >= max_tokens else 0 for w in whole]
        tail = pack([w - d for w, d in zip(whole, done, strict=True)], [max(0, p - d) for (_, _, p), d in zip(group, done, strict=True)], max_tokens, max_segments, limit)
        pieces += [(i, done[i] + a, length, n + s, at) for i, a, length, s, at in tail]
        rows = [
            (group[i][0], a, length, zlib.crc32(group[i][1][4 * a : 4 * (a + length)]), whole[i], base + s, at, max(0, a + length - max(a, group[i][2])))
            for i, a, length, s, at in pieces
        ]
        batch = pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names)
        return batch, base + 1 + max(p[3] for p in pieces)

    def run(batches):
        encode, base = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        group, held, end = [], 0, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc, text, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = (encode(text) if text else b"") + end
                group.append((doc, ids, max(0, first or 0)))
                held += len(ids) // 4
                if held >= group_tokens or len(group) >= GROUP_DOCS:
                    made, base = close(group, base)
                    yield made
                    group, held = [], 0
        if group:
            yield close(group, base)[0]

    bounded_batches(docs.sparkSession)
    first = F.lit(0).cast("long") if prompt is None else prompt.cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), first.alias("prompt")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
