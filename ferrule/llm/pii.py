"""Operator 3: personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. Tokens with a digit or an at sign are then the nodes of a field; other words
are certainly outside, and cut the chain. A node's own potential is log-linear in what can be said of the token
(ATTRIBUTES), neighbours share a chain potential, and repeated or similar tokens of a document, however far
apart, share a skip potential. Base spans and assigned secrets are observed. Loopy message passing gives each
remaining node its marginal, and what is one kind with enough probability is a further span.

Exact repeats are one node, with the mean of their potentials, so they have one label and their number changes
nothing. A node can only have a kind that there is evidence of: a repeated or similar token is observed as that
kind, or the token passes the kind's own check (a card's checksum, an address' parts, an assignment to a secret's name);
a short part beside such a repeat, if it is a part of the observed span too, counts as a repeat. Without evidence nothing is found, however often a token repeats.

The field is fitted by penalised pseudo-likelihood: each label in turn is hidden and explained by the token and
the labels around it, and once by those labels alone, as the patterns would leave nothing to explain. Spark adds up the cases of all documents in a bounded table of cells; labels weigh alike,
however many outside tokens the corpus has. Unmatched tokens that repeat or resemble a matched one are not
counted, as their label is what the field is to find.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Labels: outside, the kinds, and secrets such as keys, which are counted apart from the kinds' spans.
SECRET = len(KINDS) + 1
LABELS, UNKNOWN = SECRET + 1, SECRET + 1
#: What is said of a token, with the number of values: digits, letters, dots, at sign, checksum, address parts, plus, dashes or brackets, assignment.
ATTRIBUTES = (9, 3, 5, 2, 2, 2, 2, 2, 2)
CELLS = int(np.prod(ATTRIBUTES))
DIGIT_STEPS = (1, 4, 7, 10, 14, 16, 17, 20)
#: Weight that each label's cases have together at most, the penalty of squared weights, and the weight that two
#: occurrences of one kind have beforehand, from which (as from zero, the others) the penalty counts.
EVIDENCE, RIDGE, SAME = 1000.0, 0.1, 6.0
NEWTON_STEPS = 40
#: Own log odds of a kind over outside are kept within these, so that one certain repeat decides.
AGAINST, FOR = 2.5, 4.0
#: Rounds of messages at most, the share of the last message that stays, and the change of a message that counts as settled.
ROUNDS, DAMP, SETTLED = 500, 0.5, 1e-4
#: A kind is found where it is likelier than anything else together; evidence is asked for besides.
THRESHOLD = 0.5
#: Characters between tokens that still make them neighbours, and letters and digits that make repeats meaningful.
NEAR, ALIKE = 2, 7
#: Characters of a secret at least, and how far before it its name is looked for.
SECRET_CHARS, NAME_REACH = 16, 24

NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|credential|(?:api|access|private)[_ -]?key)\W{0,4}[=:]\W{0,4}$", re.IGNORECASE)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word with a digit or an at sign; the possessive run keeps the search linear in long words.
ACTIVE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
TRIM = "\"'`.,;:!?()[]{}<>#*$%&|"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the local part is the run before an at sign, not reaching into an earlier match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        begin = done + len(head.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start and then kind; failing matches are dropped, not retried."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def describe(word: str, assigned: bool) -> int:
    """The cell of a token: its attributes as one number."""
    digits = re.sub(r"[^0-9]", "", word)
    letters = 2 if (found := re.search(r"[^\W\d_]", word)) and digits and len(word) >= SECRET_CHARS else 1 if found else 0
    values = (
        bisect_right(DIGIT_STEPS, len(digits)), letters, min(4, word.count(".")), "@" in word,
        14 <= len(digits) <= 19 and not letters and luhn(digits), bool(ADDRESS.fullmatch(word)) and all(map(_small, word.split("."))),
        word.startswith("+"), any(c in word for c in "-()"), assigned,
    )
    cell = 0
    for value, size in zip(values, ATTRIBUTES, strict=True):
        cell = cell * size + int(value)
    return cell


def alike(word: str) -> list[str]:
    """Keys that repeated and similar tokens share: the token without case, all its digits, and its last seven."""
    digits = re.sub(r"[^0-9]", "", word)
    out = ["t" + word.lower()] if sum(map(str.isalnum, word)) >= ALIKE else []
    if len(digits) >= ALIKE and not re.search(r"[^\W\d_]", word):
        out += ["d" + digits, "s" + digits[-ALIKE:]]
    return out


class Nodes:
    """The field of one text: tokens, their cells, observed labels (-1: none), hidden ones, and both kinds of edges.

    A skip edge goes from each token to the last one before it that shares a key.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.cells, keys, labels, words = [], [], [], [], []
        for m in ACTIVE.finditer(text):
            word = m[0]
            begin = m.start() + len(word) - len(word.lstrip(TRIM))
            word = word.strip(TRIM)
            if word:
                secret = len(word) >= SECRET_CHARS and bool(NAMED.search(text[max(0, begin - NAME_REACH) : begin]))
                self.spans.append((begin, begin + len(word)))
                self.cells.append(describe(word, secret))
                keys.append(alike(word))
                words.append(word)
                labels.append(SECRET if secret else -1)
        at = 0
        for begin, kind, end in base:
            while at < len(self.spans) and self.spans[at][1] <= begin:
                at += 1
            i = at
            while i < len(self.spans) and self.spans[i][0] < end:
                if labels[i] < 0:
                    labels[i] = kind + 1
                i += 1
        self.seen = np.array(labels, np.int64)
        self.chain = [(i - 1, i) for i in range(1, len(self.spans)) if self.spans[i][0] - self.spans[i - 1][1] <= NEAR]
        last: dict[str, int] = {}
        skip = {}
        for i, mine in enumerate(keys):
            for key in mine:
                if key in last:
                    skip[last[key], i] = None
                last[key] = i
        self.skip = list(skip)
        self._merge([m.lower() for m in words], keys, labels)
        first = {key: i for i, mine in reversed(list(enumerate(keys))) if labels[i] >= 0 for key in mine}
        self.hidden = np.array([labels[i] < 0 and any(k in first for k in mine) for i, mine in enumerate(keys)], bool)


    def _merge(self, words: list[str], keys: list[list[str]], labels: list[int]) -> None:
        """The merged node of each token, and skip edges of merged nodes: to the first observed one of each label that shares a key, and to the one before."""
        known: dict[tuple, int] = {}
        self.merged, sharing = [], {}
        for i, (word, mine, label) in enumerate(zip(words, keys, labels, strict=True)):
            node = known.setdefault((word, label) if mine else (i,), len(known))
            self.merged.append(node)
            for key in mine:
                sharing.setdefault(key, {})[node] = label
        links = {}
        for members in sharing.values():
            first: dict[int, int] = {}
            for node, label in members.items():
                first.setdefault(label, node)
            first.pop(-1, None)
            before = None
            for node in members:
                for other in (*first.values(), before):
                    if other is not None and other != node:
                        links[min(other, node), max(other, node)] = None
                before = node
        short = {w: self.merged[i] for i, (w, mine, label) in enumerate(zip(words, keys, labels, strict=True)) if label > 0 and not mine}
        for edge in self.chain:
            for i, j in (edge, edge[::-1]):
                if labels[i] < 0 and not keys[i] and words[i] in short and labels[j] < 0 and keys[j]:
                    links[short[words[i]], self.merged[i]] = None
        self.links = list(links)


TABLE = "doc_id long, base array<int>, spans array<int>, cells array<int>, seen array<int>, hidden array<boolean>, chain array<int>, skip array<int>, merged array<int>, links array<int>"


def node_table(docs: DataFrame) -> DataFrame:
    """TABLE: base spans and field of every row of (doc_id, text); texts are not read again."""
    types = [pa.int64()] + [pa.list_(pa.int32())] * 4 + [pa.list_(pa.bool_())] + [pa.list_(pa.int32())] * 4
    names = [c.split()[0] for c in TABLE.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text) if text else []
                nodes = Nodes(text or "", base)
                flat = [list(chain.from_iterable(x)) for x in (base, nodes.spans, nodes.chain, nodes.skip, nodes.links)]
                rows.append((doc, flat[0], flat[1], nodes.cells, nodes.seen.tolist(), nodes.hidden.tolist(), flat[2], flat[3], nodes.merged, flat[4]))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], names)

    return docs.mapInArrow(run, TABLE)


def _pairs(flat: list[int]) -> np.ndarray:
    return np.array(flat, np.int64).reshape(-1, 2)


def cases(table: DataFrame) -> np.ndarray:
    """(case, label, n) of all documents: a case is the cell and the labels before, after and across skip edges (UNKNOWN: none).

    There are at most CELLS x (LABELS + 1)^3 x LABELS of them, whatever the corpus; the driver takes that table.
    """
    wide = LABELS + 1

    def run(batches):
        total = Counter()
        for batch in batches:
            for cells, seen, hidden, near, far in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                labels = np.maximum(np.array(seen), 0)
                labels[np.array(hidden, bool)] = UNKNOWN
                around = np.full((3, len(labels)), UNKNOWN)
                near, far = _pairs(near), _pairs(far)
                around[0, near[:, 1]] = labels[near[:, 0]]
                around[1, near[:, 0]] = labels[near[:, 1]]
                around[2, far[:, 0]] = labels[far[:, 1]]
                around[2, far[:, 1]] = labels[far[:, 0]]
                case = ((np.array(cells) * wide + around[0]) * wide + around[1]) * wide + around[2]
                total.update((case * LABELS + labels)[labels != UNKNOWN].tolist())
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["cell", "n"])

    some = table.where(F.size("cells") > 0).select("cells", "seen", "hidden", "chain", "skip")
    found = some.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    return np.array([(r["cell"] // LABELS, r["cell"] % LABELS, r["n"]) for r in found], np.int64).reshape(-1, 3)


def attributes(cells: np.ndarray) -> np.ndarray:
    """One column for each value of each attribute."""
    columns = []
    for size in reversed(ATTRIBUTES):
        columns.insert(0, np.eye(size)[cells % size])
        cells = cells // size
    return np.concatenate(columns, axis=1)


def fit(counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own (cell x label), chain and skip potentials of the greatest penalised pseudo-likelihood, by Newton's method."""
    wide, square = sum(ATTRIBUTES), LABELS * LABELS
    size = wide * LABELS + 2 * square + 1  # the last: one kind at both ends of a skip edge, whichever it is
    before_all = np.zeros(size)
    before_all[-1] = SAME
    theta = before_all.copy()
    if len(counted):
        weight = counted[:, 2].astype(float)
        totals = np.bincount(counted[:, 1], weight, LABELS)
        weight *= np.minimum(1.0, EVIDENCE / np.maximum(totals, 1.0))[counted[:, 1]]
        case, rest = np.unique(counted[:, 0], return_inverse=True)
        amounts = np.zeros((len(case), LABELS))
        np.add.at(amounts, (rest, counted[:, 1]), weight)
        width = LABELS + 1
        before, after, far = case // width**2 % width, case // width % width, case % width
        own = attributes(case // width**3)
        linked = np.flatnonzero((before < LABELS) | (after < LABELS) | (far < LABELS))  # once more without the token itself
        own = np.concatenate([own, np.zeros((len(linked), wide))])
        before, after, far, amounts = (np.concatenate([x, x[linked]]) for x in (before, after, far, amounts))

        def features(rows: slice) -> np.ndarray:
            """case x label x parameter"""
            n = len(own[rows])
            out = np.zeros((n, LABELS, size))
            at = np.arange(n)
            for label in range(LABELS):
                out[:, label, label * wide : (label + 1) * wide] = own[rows]
                for known, first, cell in ((before[rows], wide * LABELS, lambda x: x * LABELS + label), (after[rows], wide * LABELS, lambda x: label * LABELS + x)):
                    met = known < LABELS
                    np.add.at(out, (at[met], label, first + cell(known[met])), 1.0)
                met = far[rows] < LABELS
                for cell in (far[rows][met] * LABELS + label, label * LABELS + far[rows][met]):  # the table is symmetric
                    np.add.at(out, (at[met], label, wide * LABELS + square + cell), 0.5)
                out[:, label, -1] = (far[rows] == label) & (label > 0)
            return out

        def measure(theta: np.ndarray, slopes: bool = True):
            moved = theta - before_all
            loss, slope, curve = 0.5 * RIDGE * moved @ moved, RIDGE * moved, RIDGE * np.eye(size)
            for lo in range(0, len(own), 256):
                rows = slice(lo, lo + 256)
                x, y = features(rows), amounts[rows]
                logits = x @ theta
                logits -= np.logaddexp.reduce(logits, axis=1, keepdims=True)
                loss -= (y * logits).sum()
                if slopes:
                    p, n = np.exp(logits), y.sum(axis=1)
                    mean = np.einsum("cl,clf->cf", p, x)
                    slope = slope + n @ mean - np.einsum("cl,clf->f", y, x)
                    scaled = x * np.sqrt(n[:, None] * p)[:, :, None]
                    scaled = scaled.reshape(-1, size)
                    mean = mean * np.sqrt(n)[:, None]
                    curve = curve + scaled.T @ scaled - mean.T @ mean
            return loss, slope, curve

        for _ in range(NEWTON_STEPS):
            loss, slope, curve = measure(theta)
            step = np.linalg.solve(curve, slope)
            scale = 1.0
            while scale > 1e-6 and measure(theta - scale * step, slopes=False)[0] > loss - 1e-4 * scale * slope @ step:
                scale /= 2
            theta = theta - scale * step
            if slope @ step < 1e-6:
                break
    own = attributes(np.arange(CELLS)) @ theta[: wide * LABELS].reshape(LABELS, wide).T
    odds = np.clip(own - own[:, :1], -AGAINST, FOR)
    along, across = theta[wide * LABELS : -1].reshape(2, LABELS, LABELS)
    return odds, along, (across + across.T) / 2 + theta[-1] * np.diag(np.arange(LABELS) > 0)


def settle(local: np.ndarray, seen: np.ndarray, near: np.ndarray, far: np.ndarray, model, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Label probabilities of each node by loopy belief propagation, and the last change of a message, above SETTLED where ROUNDS ended it.

    Observed nodes are certain. ``weights`` scale the chain potentials of near edges.
    """
    _, along, across = model
    local = local.copy()
    known = np.flatnonzero(seen >= 0)
    local[known] = -60.0
    local[known, seen[known]] = 0.0
    pair, moved = np.concatenate([near, far]), 0.0
    if len(pair):
        strength = np.ones(len(near)) if weights is None else weights
        tables = np.concatenate([along[None] * strength[:, None, None], np.repeat(across[None], len(far), 0)])
        source, target = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([pair[:, 1], pair[:, 0]])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(pair)) + len(pair), np.arange(len(pair))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, target, sent)
            out = belief[source] - sent[back]
            new = np.logaddexp.reduce(out[:, :, None] + tables, axis=1)
            new -= new.max(axis=1, keepdims=True)
            moved = float(np.abs(new - sent).max())
            sent = DAMP * sent + (1 - DAMP) * new
            if moved < SETTLED:
                break
        np.add.at(local, target, sent)
    local = np.exp(local - local.max(axis=1, keepdims=True))
    return local / local.sum(axis=1, keepdims=True), moved


def marginals(cells: np.ndarray, seen: np.ndarray, near: np.ndarray, far: np.ndarray, model) -> np.ndarray:
    return settle(model[0][cells], seen, near, far, model)[0]


def _values(cells: np.ndarray) -> list[np.ndarray]:
    """The value of each attribute."""
    out = []
    for size in reversed(ATTRIBUTES):
        out.insert(0, cells % size)
        cells = cells // size
    return out


def evidence(cells: np.ndarray, seen: np.ndarray, far: np.ndarray) -> np.ndarray:
    """node x label: may it have the label? Outside always; a kind by what is observed across skip edges, or by the token's own check."""
    root = np.arange(len(cells))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in far.tolist():
        root[find(b)] = find(a)
    root = np.array([find(i) for i in range(len(cells))], np.int64)
    may = np.zeros((len(cells), LABELS), bool)
    observed = np.flatnonzero(seen > 0)
    may[root[observed], seen[observed]] = True
    may = may[root]
    checksum, address, assigned = (_values(cells)[k] for k in (4, 5, 8))
    may[:, KINDS.index("card") + 1] |= checksum.astype(bool)
    may[:, KINDS.index("ip") + 1] |= address.astype(bool)
    may[:, SECRET] |= assigned.astype(bool)
    may[:, 0] = True
    return may


def merged_marginals(cells: np.ndarray, seen: np.ndarray, near: np.ndarray, merged: np.ndarray, links: np.ndarray, model) -> tuple[np.ndarray, float]:
    """Label probabilities of each token, those of its merged node, and the change that was left when messages ended."""
    n = int(merged.max()) + 1
    size = np.bincount(merged, minlength=n)
    local = np.zeros((n, LABELS))
    np.add.at(local, merged, model[0][cells])
    first = np.unique(merged, return_index=True)[1]
    edges = merged[near]
    edges = edges[edges[:, 0] != edges[:, 1]]
    pairs, counts = np.unique(edges, axis=0, return_counts=True) if len(edges) else (edges, np.zeros(0))
    weights = counts / np.maximum(size[pairs[:, 0]], size[pairs[:, 1]])
    local = np.where(evidence(cells[first], seen[first], links), local / size[:, None], -60.0)
    odds, left = settle(local, seen[first], pairs, links, model, weights)
    return odds[merged], left


def further_spans(spans: np.ndarray, cells: np.ndarray, seen: np.ndarray, near: np.ndarray, merged: np.ndarray, links: np.ndarray, model, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, int]], float]:
    """(start, label - 1, end) of what the field adds, and the change left: unobserved nodes of one likely label; the parts of a phone number are one span."""
    if not (seen < 0).any():
        return [], 0.0
    odds, left = merged_marginals(cells, seen, near, merged, links, model)
    best = odds.argmax(axis=1)
    likely = (seen < 0) & (best > 0) & (odds[np.arange(len(best)), best] >= threshold)
    joined, out, before = set(near[:, 1].tolist()), [], -1
    short = _values(cells)[0] <= 2  # digits: a part of a number, not all of one
    for i in np.flatnonzero(likely).tolist():
        kind = int(best[i]) - 1
        if kind == KINDS.index("phone") and i - 1 == before and i in joined and out[-1][1] == kind and (short[i] or short[i - 1]):
            out[-1] = (out[-1][0], kind, int(spans[i, 1]))
        else:
            out.append((int(spans[i, 0]), kind, int(spans[i, 1])))
        before = i
    return out, left


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame, train_on: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), and for every row n_added (spans that
    the field adds), n_secret (secrets, assigned to a name or found by the field; not among the spans), n_found (all), and
    unsettled (the last change of a message where ROUNDS ended the field before it settled, else 0).

    Null and empty texts have no spans. Repeated rows are searched one by one, a null doc_id stays null; other columns
    are ignored; an empty table gives no rows. Spans of different kinds may overlap; the field never adds to an
    observed token.
    """
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "pii")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    nodes = work.keep(node_table(docs.select(columns)), "nodes")
    model = docs.sparkSession.sparkContext.broadcast(fit(cases(nodes if train_on is None else work.keep(node_table(train_on.select(columns)), "training"))))
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_secret", "n_found", "unsettled"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.float64()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, flat, spans, cells, seen, near, merged, links in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                base = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
                seen = np.array(seen, np.int64)
                more, left = further_spans(_pairs(spans), np.array(cells, np.int64), seen, _pairs(near), np.array(merged, np.int64), _pairs(links), model.value, threshold)
                added = [x for x in more if x[1] < len(KINDS)]
                secrets = int((seen == SECRET).sum()) + len(more) - len(added)
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((doc, *[kinds.count(k) for k in range(len(KINDS))], digest, _joined(sorted(base + added)), len(added), secrets, len(base) + len(more) + int((seen == SECRET).sum()), left if left >= SETTLED else 0.0))
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(names), types, strict=True)], names)

    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in zip(names, types, strict=True))
    return nodes.select("doc_id", "base", "spans", "cells", "seen", "chain", "merged", "links").mapInArrow(run, schema)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
