"""The largest cosine to a set of compositions, by element postings with upper bounds.

An index holds, for each element, its compositions in falling order of that element's share of the norm. A candidate
reads the lists of its own elements side by side. What it has not met by some depth has, in each element, at most the
share found there, and a norm of one; the largest cosine that these limits allow is known in closed form, and once it
is below the best cosine met, nothing further can be larger. The result is exact, and most pairs are never looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS

#: Candidates that one pass over a branch's training serves, and training compositions that are indexed at once.
GROUP, INDEXED = 4096, 16_384
#: Entries that each list yields first and at most in a round, and entries that are looked at at once.
FIRST, MOST, AT_ONCE = 16, 1024, 1 << 18
#: More than the rounding of a bound.
SLACK = 1e-9


class Vectors:
    """Compositions as padded rows of element numbers and amounts; the pad is an element of no amount."""

    def __init__(self, terms: pa.ListArray):
        symbol, amount = terms.flatten().flatten()
        lengths = terms.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shape = (len(lengths), int(lengths.max(initial=1)))
        self.element = np.full(shape, len(SYMBOLS))
        self.element[row, place] = pc.index_in(symbol, pa.array(SYMBOLS)).to_numpy()
        self.amount = np.zeros(shape)
        self.amount[row, place] = amount.to_numpy()
        self.norm = np.sqrt((self.amount * self.amount).sum(axis=1))
        self.share = self.amount / self.norm[:, None]


def largest(share: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The largest dot product of each unit row with a unit vector that is at most ``limit`` in each place.

    Without limits it is the row itself; places where a multiple of the row is above its limit stay at the limit, and
    the norm that is left goes to the others in proportion.
    """
    at_limit = np.zeros(share.shape, bool)
    for _ in range(share.shape[1] + 1):
        left = np.maximum(1 - (limit * limit * at_limit).sum(axis=1), 0)
        free = (share * share * ~at_limit).sum(axis=1)
        scale = np.sqrt(np.divide(left, free, out=np.zeros_like(left), where=free > 0))
        over = ~at_limit & (limit < scale[:, None] * share)
        if not over.any():
            break
        at_limit |= over
    return (share * np.where(at_limit, limit, scale[:, None] * share)).sum(axis=1)


class Postings:
    """Lists of the compositions of each element, by falling share."""

    def __init__(self, vectors: Vectors):
        self.vectors = vectors
        row, place = np.nonzero(vectors.amount)
        element, share = vectors.element[row, place], vectors.share[row, place]
        order = np.lexsort((-share, element))
        self.row, self.share = row[order], np.append(share[order], 0.0)
        ends = np.searchsorted(element[order], np.arange(len(SYMBOLS) + 1), "right")
        self.end = ends
        self.end[-1] = ends[-2]  # the pad's list is empty
        self.start = np.concatenate([[0], ends[:-1]])

    def improve(self, mine: Vectors, dense: np.ndarray, best: np.ndarray, looked: np.ndarray) -> None:
        """Raise ``best`` of each candidate to its largest cosine here, and count the compositions looked at."""
        active, depth, step = np.arange(len(best)), 0, FIRST
        while len(active):
            start, end = self.start[mine.element[active]] + depth, self.end[mine.element[active]]
            limit = np.where(start < end, self.share[np.minimum(start, len(self.row))], 0.0)
            going = (limit > 0).any(axis=1) & (largest(mine.share[active], limit) + SLACK >= best[active])
            active, start, end = active[going], start[going], end[going]
            wide = max(1, AT_ONCE // (step * mine.element.shape[1]))
            for at in range(0, len(active), wide):
                self._look(mine, dense, best, looked, active[at : at + wide], start[at : at + wide], end[at : at + wide], step)
            depth, step = depth + step, min(2 * step, MOST)

    def _look(self, mine, dense, best, looked, active, start, end, step) -> None:
        place = start[:, :, None] + np.arange(step)
        which, _, _ = found = np.nonzero(place < end[:, :, None])
        if not len(which):
            return
        who, row = active[which], self.row[place[found]]
        them = self.vectors
        dots = (dense[who[:, None], them.element[row]] * them.amount[row]).sum(axis=1)
        cosine = np.clip(dots / (mine.norm[who] * them.norm[row]), 0.0, 1.0)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        best[who[first]] = np.maximum(best[who[first]], np.maximum.reduceat(cosine, first))
        looked[who[first]] += np.diff(np.append(first, len(who)))


class Search:
    """One group's candidates, and the training that streams past them."""

    def __init__(self):
        self.candidates: list[pa.RecordBatch] = []
        self.waiting: list[pa.Array] = []
        self.n_waiting = self.n_training = 0
        self.mine = None

    def add(self, batch: pa.RecordBatch, training: bool) -> None:
        if not training:
            self.candidates.append(batch)
            return
        if self.candidates:
            self.waiting.append(batch.column("terms"))
            self.n_waiting += len(batch)
            self.n_training += len(batch)
            if self.n_waiting >= INDEXED:
                self._index()

    def _index(self) -> None:
        if self.mine is None:
            self.mine = Vectors(pa.concat_arrays([b.column("terms") for b in self.candidates]))
            self.best, self.looked = np.zeros(len(self.mine.norm)), np.zeros(len(self.mine.norm), np.int64)
            self.dense = np.zeros((len(self.mine.norm), len(SYMBOLS) + 1))
            np.put_along_axis(self.dense, self.mine.element, self.mine.amount, axis=1)
            self.dense[:, -1] = 0
        Postings(Vectors(pa.concat_arrays(self.waiting))).improve(self.mine, self.dense, self.best, self.looked)
        self.waiting, self.n_waiting = [], 0

    def result(self, names: Sequence[str]):
        """The candidates with value, looked and pool; none without training."""
        if self.waiting:
            self._index()
        at = 0
        for b in self.candidates if self.n_training else ():
            n = len(b)
            more = [pa.array(self.best[at : at + n]), pa.array(self.looked[at : at + n]), pa.array(np.full(n, self.n_training))]
            yield pa.record_batch([*[b.column(c) for c in names], *more], [*names, "value", "looked", "pool"])
            at += n


def nearest(candidates: DataFrame, training: DataFrame, keys: Sequence[str], group: int = GROUP) -> DataFrame:
    """(keys, composition, value, looked, pool): the largest cosine to the branch's training, and how much of it was looked at.

    Candidates of a branch are dealt into groups of about ``group``, and each group is a key that its rows and the
    branch's training share, so tasks grow with the candidates. A task holds one group and one index; training rows
    pass it as a stream. ``looked`` may count a composition once for each element that both have. A branch without
    training has no rows; branches come from settings, so the table of their sizes is small.
    """
    keys = list(keys)
    sizes = F.broadcast(candidates.groupBy(*keys).agg(F.ceil(F.count("*") / group).alias("__of")))
    mine = candidates.select(*keys, "composition", "terms").join(sizes, keys).withColumn("__group", F.pmod(F.xxhash64("composition"), F.col("__of"))).drop("__of")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))
    them = training.select(*keys, "composition", "terms").join(sizes, keys).withColumn("__group", each).drop("__of")
    rows = mine.withColumn("__training", F.lit(False)).unionByName(them.withColumn("__training", F.lit(True)))
    rows = rows.withColumn("__key", F.to_json(F.struct(*keys, "__group"))).drop("__group").repartition("__key").sortWithinPartitions("__key", "__training")
    names = [*keys, "composition"]

    def run(batches):
        search, now = Search(), None
        for batch in batches:
            key, side = batch.column("__key"), batch.column("__training").to_numpy(zero_copy_only=False)
            changed = (pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) | (side[1:] != side[:-1])
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key[a].as_py() != now:
                    yield from search.result(names)
                    search, now = Search(), key[a].as_py()
                search.add(batch.slice(a, b - a), bool(side[a]))
        yield from search.result(names)

    schema = ", ".join([*[f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys], "composition string, value double, looked long, pool long"])
    return rows.select(*keys, "composition", "terms", "__training", "__key").mapInArrow(run, schema)
