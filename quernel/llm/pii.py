"""Personal information in free text, by a skip-chain conditional random field.

A text becomes tokens: words, signs, and runs of digits and letters that form
one number, code or mail address. A conditional random field labels them, with
B and I labels for each kind, from features of the token and its neighbours.
Equal or similar rare words far apart in one text (similar: but for an ending or
one letter) share a potential that favours equal kinds; loopy message passing between chain and skip links makes the labels of
a document consistent. The field is trained on invented texts (pii_texts), set
among the ordinary clauses of all texts of the input, which show what the
corpus's ordinary sentences look like.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.canonical import _INVISIBLE
from quernel.llm.pii_texts import KINDS, SENTENCES, Maker
from quernel.workspace import materialise, spread

#: In how many texts a pair of words must stand to be ordinary, and in which share of them, as one in so many.
FREQUENT = 5
ONE_IN = 4_800
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 200_000
#: Invented texts of training at least; there are more where these don't hold every ordinary clause.
TRAINING_TEXTS = 6000
#: Clauses among which one task trains at most, and in how many steps of 1 weights are summed.
PART = 8_000
SCALE = 1 << 32
EPOCHS = 6
#: Strengths of skip links that are tried on development texts when fitting, for equal and for similar words, and the number of these texts.
STRENGTHS = (0.0, 0.4, 0.8, 1.2, 1.6, 2.0)
DEVELOPMENT_TEXTS = 400
#: One in so many training sentences is kept from the first field, to make development texts of.
KEPT_APART = 3
#: Strength of an unfitted field's links.
SKIP = 1.2
#: Rounds of message passing.
ROUNDS = 3
#: Words of fewer letters aren't similar to others.
LEAST_LETTERS = 5

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N = len(LABELS)
KIND_OF = [None, *(k for k in KINDS for _ in "BI")]
_START = np.array([-1e4 if x.startswith("I-") else 0.0 for x in LABELS])
_ALLOWED = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] and a != "O" else -1e4 for b in LABELS] for a in LABELS])
_TINY = np.float32(1e-30)
_SAME = np.array([[1.0 if a == b else -1.0 for b in KIND_OF] for a in KIND_OF])

_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+(?=\w+\s+dot\s))"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
#: A word before a sign or another word, at which no token of another type begins, is told first ("plain"): most are such.
TOKEN = re.compile(
    rf"""(?P<plain>[^\W\d_]++(?=[,?!;]|\.?\Z|\.\s|\s[^\W\d_a]))
    |(?P<mail>(?:mailto:)?[\w.+-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]*\w)+)
    |(?P<date>\d{{4}}-\d\d-\d\d(?!\d)|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}}(?!\d))
    |(?P<nino>\b[A-Za-z]{{2}}(?:\s\d\d){{3}}\s[A-Za-z]\b)
    |(?P<run>[+(]?\(?\d+\)?(?:(?:[ .\-/  ]|\)\ ?|\ \()(?!\d{{4}}-\d\d-\d\d)\d+)+(?:-?[A-Za-z]\b|-[A-Za-z])?(?:\ ?(?:ext|x|App|poste)\.?\ ?\d+)?)
    |(?P<long>\+\d{{6,}})
    |(?P<code>[#@]?[\w]*(?:\d[\w]*)(?:[@#\-_/.][\w]+)*|[#@]\w+|\w+(?:[_.@=]\w+)+)
    |(?P<word>[^\W\d_]+(?:['’\-][^\W\d_]+)*)
    |(?P<sign>[^\s\w]|_)""",
    re.X | re.I,
)
_FIRMS = {"ltd", "inc", "gmbh", "ag", "sarl", "llc", "bv", "kg", "plc", "sas", "co"}


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(token, start, end, type) of a text."""
    return [(m[0], *m.span(), "word" if (kind := m.lastgroup) == "plain" else kind) for m in TOKEN.finditer(text)]


def case_of(text: str) -> str:
    """Whether letter case tells anything in a text: mixed, or all lower, upper or title."""
    words = re.findall(r"[^\W\d_]{2,}", text)
    if len(words) < 4:
        return "m"
    lower, upper, title = (sum(map(f, words)) / len(words) for f in (str.islower, str.isupper, str.istitle))
    return "l" if lower == 1 else "u" if upper > 0.85 else "t" if title > 0.85 else "m"


def _form(ch: str) -> str:
    return "9" if ch.isdecimal() else ("X" if ch.isupper() else "x") if ch.isalnum() else ch


_FORMS = {i: _form(chr(i)) for i in range(0x250)}


@lru_cache(maxsize=100_000)
def shape(token: str) -> str:
    s = token.translate(_FORMS)
    if not s.isascii():
        s = "".join(map(_form, token))
    return s if re.search(r"\d", token) else re.sub(r"(.)\1+", r"\1", s)


def features(token: str, kind: str, case: str, common: set[str]) -> tuple[list[str], list[str]]:
    """Features of a token for its own label, and for its neighbours' labels."""
    low = token.lower()
    if kind in ("word", "sign"):
        form = shape(token) if kind == "word" else token
        known = "k" if low in common or kind == "sign" else "u"
        near = [f"w={low}", f"s={case}{form}", f"c={known}{case}{form}"]
        own = [*near, f"c={known}"]
        if kind == "word":
            own += [f"e={low[-3:]}", f"e={low[-4:]}", f"l={min(len(low), 8)}", f"b={low[:3]}"]
            if low in _FIRMS:
                near.append("firm")
        return own, near
    digits = sum(ch.isdigit() for ch in token)
    wide = re.sub(r"9+", "9", re.sub(r"[a-z]+", "a", shape(token).lower().replace("x", "a")))
    own = [f"t={kind}", f"n={shape(token)}", f"d={digits}", f"v={wide}", f"h={token[0] if not token[0].isalnum() else '0' if token[0] == '0' else 'x'}"]
    return own, [f"t={kind}", f"d={min(digits, 9)}", f"v={wide}"]


OFFSETS = (-2, -1, 0, 1, 2)
NEIGHBOURS = (-2, -1, 1, 2)
#: Where the weights of an offset stand in training: neighbours', then a token's own.
_PLACE = {o: i for i, o in enumerate((*NEIGHBOURS, 0))}
#: Features that a token has at most for its own label and for its neighbours'.
MOST_OWN, MOST_NEAR = 8, 4
#: Tokens, but for those of one text, whose weights are put together at once in use.
TOKENS_AT_ONCE = 50_000
#: Rows of a sum that are added in turns with those of the others.
SHORT = 8


class _Batch:
    """What a gradient step on labelled texts in order of length needs; places are numbered by position, then by text."""

    def __init__(self, data: list[tuple[np.ndarray, np.ndarray]], own_of: np.ndarray, near_of: np.ndarray) -> None:
        n = np.array([len(y) for _, y in data])
        self.size, self.width = len(n), int(n.max())
        #: The first text that has a token at each position.
        self.starts = np.searchsorted(n, np.arange(self.width), side="right").tolist()
        at, text = np.concatenate([np.arange(m) for m in n]), np.repeat(np.arange(len(n)), n)
        self.inside, self.labels = at * self.size + text, np.concatenate([y for _, y in data])
        which, row = np.unique(np.concatenate([r for r, _ in data]), return_inverse=True)
        self.by_row = _Sums(row, self.inside)
        which, row = which[self.by_row.order], np.argsort(self.by_row.order)[row]
        self.rows = len(which)
        self.places = np.full(self.width * self.size, self.rows)
        self.places[self.inside] = row
        self.outside = np.flatnonzero(self.places == self.rows)
        later = at > 0
        self.ahead = self.inside[later]
        self.behind = self.ahead - self.size
        self.steps = self.labels[:-1][later[1:]] * N + self.labels[1:][later[1:]]
        own, near = own_of[which], near_of[which]
        self.own, self.near = ([some[:, k].copy() for k in range(some.shape[1]) if some[:, k].any()] for some in (own, near))
        # A token speaks for a neighbour only where there is one.
        ends = np.repeat(n, n)
        on = np.zeros((self.rows, len(NEIGHBOURS)), bool)
        for k, o in enumerate(NEIGHBOURS):
            on[row[(at - o >= 0) & (at - o < ends)], k] = True
        self.own_use, self.near_use = _use(own, np.ones((self.rows, 1), bool)), _use(near, on)


class _Sums:
    """Sums of rows of a matrix, ``rows``, for each number in ``of``; the results are in ``order``, those of most rows first."""

    def __init__(self, of: np.ndarray, rows: np.ndarray) -> None:
        by_number = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by_number], np.arange(of.max() + 1))
        counts = np.diff([*starts, len(of)])
        self.order = np.argsort(-counts, kind="stable")
        starts, counts, rows = starts[self.order], counts[self.order], rows[by_number]
        #: The first, second ... row of each sum that has so many, and what is left of the longer ones.
        self.turns = [rows[starts[: np.count_nonzero(counts > k)] + k] for k in range(min(SHORT, int(counts.max())))]
        long = np.count_nonzero(counts > SHORT)
        self.rest = np.concatenate([rows[a + SHORT : a + c] for a, c in zip(starts[:long].tolist(), counts[:long].tolist(), strict=True)]) if long else None
        self.rest_starts = np.cumsum([0, *(counts[: long - 1] - SHORT)]) if long else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = x.take(self.turns[0], axis=0)
        for some in self.turns[1:]:
            out[: len(some)] += x.take(some, axis=0)
        if self.rest is not None:
            out[: len(self.rest_starts)] += np.add.reduceat(x.take(self.rest, axis=0), self.rest_starts, axis=0)
        return out


def _use(ids: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, _Sums, np.ndarray | None]:
    """The features of rows, sums of rows by feature, and the weights (1 or 0) that no row speaks with if there are such."""
    flat = np.flatnonzero(ids)
    used, of = np.unique(ids.ravel()[flat], return_inverse=True)
    rows = flat // ids.shape[1]
    sums = _Sums(of, rows)
    live = np.zeros((len(used), on.shape[1]), bool)
    np.logical_or.at(live, of, on[rows])
    return used[sums.order], sums, None if live.all() else np.repeat(live[sums.order], N, axis=1).astype(np.float32)


def _summed(weights: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    out = weights.take(ids[0], axis=0)
    for some in ids[1:]:
        out += weights.take(some, axis=0)
    return out


def _moved(weights: np.ndarray, squares: np.ndarray, by_row: np.ndarray, use: tuple, b: int, rate: float, l2: float) -> None:
    """Moves the weights of used features along the gradient, which is given by row."""
    used, sums, live = use
    old, g2 = weights.take(used, axis=0), squares.take(used, axis=0)
    g = sums(by_row)
    g /= b
    g -= l2 * old
    if live is not None:
        g *= live
    g2 += g * g
    squares[used] = g2
    g *= rate
    g /= np.sqrt(g2, out=g2)
    old += g
    weights[used] = old


class Field:
    """The conditional random field: weights of features by offset, transitions, common words."""

    def __init__(self, common: set[str]) -> None:
        self.common = common
        self.ids: dict[tuple[int, str], int] = {}
        self.weights = np.zeros((0, N), np.float32)
        self.trans = np.zeros((N, N), np.float32)
        self.skip, self.skip_similar = SKIP, SKIP / 2
        self._forget()

    def _forget(self) -> None:
        """Drops what is kept of tokens and words seen in use."""
        self._rows: dict[tuple[str, str, str], int] = {}
        self._table = np.zeros((1, len(OFFSETS), N), np.float32)
        self._rare: dict[str, tuple] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "_table", "_rare")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def feature_ids(self, token: str, kind: str, case: str) -> list[list[int]]:
        own, near = features(token, kind, case, self.common)
        return [[i for f in (near if o else own) if (i := self.ids.get((o, f))) is not None] for o in OFFSETS]

    def _known(self, keys: list[tuple[str, str, str]]) -> None:
        """Has the table of summed weights (offset x label) hold these tokens; its first row is zero."""
        if len(self._rows) > 200_000:
            self._forget()
        new = [k for k in dict.fromkeys(keys) if k not in self._rows]
        if not new:
            return
        first = len(self._rows) + 1
        if first + len(new) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros((len(self._table) + len(new), *self._table.shape[1:]), np.float32)])
        ids = np.full((len(new), len(OFFSETS), MOST_OWN), -1)
        for i, key in enumerate(new):
            self._rows[key] = first + i
            for j, some in enumerate(self.feature_ids(*key)):
                ids[i, j, : len(some)] = some
        for i in range(0, len(new), 1000):
            some = ids[i : i + 1000]
            said = self.weights[some] if len(self.weights) else np.zeros((*some.shape, N), np.float32)
            said[some < 0] = 0
            self._table[first + i : first + i + len(some)] = said.sum(axis=2)

    def unaries(self, toks: list[tuple[str, int, int, str]], case: str) -> np.ndarray:
        return self.unaries_of([(toks, case)])[0]

    def unaries_of(self, texts: list[tuple[list[tuple[str, int, int, str]], str]]) -> list[np.ndarray]:
        """What the tokens of each text and their neighbours say for each label."""
        out, start, held = [], 0, 0
        for i, (toks, _) in enumerate(texts):
            held += len(toks)
            if held > TOKENS_AT_ONCE or i + 1 == len(texts):
                out += self._unaries_of(texts[start : i + 1])
                start, held = i + 1, 0
        return out

    def _unaries_of(self, texts: list[tuple[list[tuple[str, int, int, str]], str]]) -> list[np.ndarray]:
        keys = [[(t[0], t[3], case) for t in toks] for toks, case in texts]
        self._known([k for some in keys for k in some])
        gap = [0] * OFFSETS[-1]  # no token speaks beyond its text
        said = self._table[[r for some in keys for r in (*map(self._rows.__getitem__, some), *gap)]]
        out = np.zeros((len(said), N), np.float32)
        n = len(said)
        for k, o in enumerate(OFFSETS):  # the token at t + o speaks for t
            out[max(0, -o) : max(0, n - o)] += said[max(0, o) : max(0, n + o), k]
        ends = np.cumsum([len(some) + len(gap) for some in keys]).tolist()
        return [out[e - len(gap) - len(some) : e - len(gap)] for e, some in zip(ends, keys, strict=True)]

    # -- inference, over a batch of texts of one padded length -----------------

    def _messages(self, u: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log marginals (text, position, label), not normalised past a text's end."""
        b, t, _ = u.shape
        tr = self.trans + _ALLOWED
        fwd = np.empty_like(u)
        fwd[:, 0] = u[:, 0] + _START
        for i in range(1, t):
            x = fwd[:, i - 1, :, None] + tr
            m = x.max(axis=1)
            fwd[:, i] = m + np.log(np.exp(x - m[:, None]).sum(axis=1)) + u[:, i]
        back = np.zeros_like(u)
        for i in range(t - 2, -1, -1):
            x = tr[None] + (u[:, i + 1] + back[:, i + 1])[:, None, :]
            m = x.max(axis=2)
            back[:, i] = np.where((i + 1 < n)[:, None], m + np.log(np.exp(x - m[:, :, None]).sum(axis=2)), 0)
        return fwd + back

    def _best(self, u: np.ndarray, n: np.ndarray) -> np.ndarray:
        b, t, _ = u.shape
        tr = self.trans + _ALLOWED
        score = u[:, 0] + _START
        back = np.zeros((b, t, N), np.int8)
        for i in range(1, t):
            x = score[:, :, None] + tr
            back[:, i] = x.argmax(axis=1)
            new = x.max(axis=1) + u[:, i]
            score = np.where((i < n)[:, None], new, score)
        out = np.zeros((b, t), np.int8)
        last = score.argmax(axis=1)
        rows = np.arange(b)
        for i in range(t - 1, -1, -1):
            inside = i < n
            out[:, i] = np.where(inside, last, 0)
            if i:
                last = np.where(inside, back[rows, i, last], last)
        return out

    def label(self, us: list[np.ndarray], links: list[list[tuple[int, int]]], similar: list[list[tuple[int, int]]] | None = None) -> list[np.ndarray]:
        """The labels of each text, given its unaries and its skip links of equal and of similar words."""
        similar = similar or [[]] * len(us)
        order = sorted(range(len(us)), key=lambda i: len(us[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(us)
        start = 0
        while start < len(order):
            size = max(1, min(256, 60_000 // max(1, len(us[order[min(start + 255, len(order) - 1)]]))))
            group = order[start : start + size]
            start += size
            n = np.array([len(us[i]) for i in group])
            if not n.max():
                continue
            u = np.zeros((len(group), n.max(), N), np.float32)
            for k, i in enumerate(group):
                u[k, : n[k]] = us[i]
            linked = [k for k, i in enumerate(group) if links[i] or similar[i]]
            if linked:
                u[linked] = self._consistent(u[linked], n[linked], [links[group[k]] for k in linked], [similar[group[k]] for k in linked])
            best = self._best(u, n)
            for k, i in enumerate(group):
                out[i] = best[k, : n[k]]
        return out

    def _consistent(self, u: np.ndarray, n: np.ndarray, links: list[list[tuple[int, int]]], similar: list[list[tuple[int, int]]]) -> np.ndarray:
        """Unaries with the messages of the skip links, after rounds of loopy message passing."""
        edges = [(k, a, b, w) for every, w in ((links, self.skip), (similar, self.skip_similar)) for k, some in enumerate(every) for i, j in some for a, b in ((i, j), (j, i))]
        at, src, dst, strength = (np.array(x) for x in zip(*edges, strict=True))
        pot = (strength[:, None, None] * _SAME).astype(np.float32)
        reverse = np.arange(len(edges)) ^ 1
        sent = np.zeros((len(edges), N), np.float32)
        for _ in range(ROUNDS):
            now = u.copy()
            np.add.at(now, (at, dst), sent)
            belief = self._messages(now, n)[at, src] - sent[reverse]  # without what came over this link
            x = belief[:, :, None] + pot
            m = x.max(axis=1)
            out = m + np.log(np.exp(x - m[:, None]).sum(axis=1))
            sent = out - out.max(axis=1, keepdims=True)
        now = u.copy()
        np.add.at(now, (at, dst), sent)
        return now

    # -- training --------------------------------------------------------------

    def train(self, texts: list[list[tuple[str, str | None]]], epochs: int = EPOCHS, rate: float = 0.25, l2: float = 2e-6, seed: int = 1) -> None:
        """Maximises the likelihood of labelled texts by stochastic gradient steps."""
        data = []
        seen: dict[tuple[str, str, str], int] = {}
        # Features for a token's own label, and for its neighbours' labels: these have weights for all neighbours in one row. Row 0, of no feature, stays zero.
        own_ids: dict[str, int] = {"": 0}
        near_ids: dict[str, int] = {"": 0}
        own_of, near_of = [], []
        for pieces in texts:
            toks, labels = labelled(pieces)
            case = case_of("".join(p[0] for p in pieces))
            rows = []
            for t in toks:
                key = (t[0], t[3], case)
                r = seen.get(key)
                if r is None:
                    r = seen[key] = len(seen)
                    own, near = features(*key, self.common)
                    own_of.append([own_ids.setdefault(f, len(own_ids)) for f in own] + [0] * (MOST_OWN - len(own)))
                    near_of.append([near_ids.setdefault(f, len(near_ids)) for f in near] + [0] * (MOST_NEAR - len(near)))
                rows.append(r)
            if toks:
                data.append((np.array(rows), np.array(labels)))
        own_of, near_of = np.array(own_of, np.int32).reshape(-1, MOST_OWN), np.array(near_of, np.int32).reshape(-1, MOST_NEAR)
        own, near = np.zeros((len(own_ids), N), np.float32), np.zeros((len(near_ids), len(NEIGHBOURS) * N), np.float32)
        sums = np.full_like(own, 1e-4), np.full_like(near, 1e-4), np.full_like(self.trans, 1e-4)
        data.sort(key=lambda d: len(d[1]))
        rng = np.random.default_rng(seed)
        batches = [_Batch(data[i : i + 48], own_of, near_of) for i in range(0, len(data), 48)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                self._step(batches[b], own, near, *sums, rate, l2)
        keys = [*((0, f) for f in own_ids if f), *((o, f) for f in near_ids if f for o in NEIGHBOURS)]
        self.ids = {k: i for i, k in enumerate(keys)}
        self.weights = np.concatenate([own[1:], near[1:].reshape(-1, N)])

    def _step(self, batch: _Batch, own: np.ndarray, near: np.ndarray, own2: np.ndarray, near2: np.ndarray, t2: np.ndarray, rate: float, l2: float) -> None:
        """One gradient step on a batch, on weights ``own`` and ``near``; the others are sums of squared gradients."""
        b, t, starts = batch.size, batch.width, batch.starts
        near_n = near.shape[1]
        said = np.zeros((batch.rows + 1, near_n + N), np.float32)  # the last row is that of places past a text's end
        said[:-1, :near_n] = _summed(near, batch.near)
        said[:-1, near_n:] = _summed(own, batch.own)
        said = said.take(batch.places, axis=0).reshape(t, b, len(OFFSETS), N)
        u = np.zeros((t, b, N), np.float32)
        for o in OFFSETS:  # the token at t + o speaks for t
            u[max(0, -o) : max(0, t - o)] += said[max(0, o) : max(0, t + o), :, _PLACE[o]]
        # Forward and backward sums as probabilities, scaled at every token, so that a step along the chain is one product of matrices.
        step = np.exp(self.trans + _ALLOWED).astype(np.float32)
        at = np.exp(u - u.max(axis=2, keepdims=True)) + _TINY
        fwd, back = np.ones_like(at), np.ones_like(at)
        fwd[0] = at[0] * np.exp(_START)
        fwd[0] /= fwd[0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            k = starts[i]
            x = fwd[i - 1, k:] @ step
            x *= at[i, k:]
            np.divide(x, np.add.reduce(x, axis=1, keepdims=True), out=fwd[i, k:])
        for i in range(t - 2, -1, -1):
            k = starts[i + 1]
            x = (at[i + 1, k:] * back[i + 1, k:]) @ step.T
            np.divide(x, np.add.reduce(x, axis=1, keepdims=True), out=back[i, k:])
        delta = fwd * back
        delta /= delta.sum(axis=2, keepdims=True)
        np.negative(delta, out=delta)
        delta = delta.reshape(t * b, N)
        delta[batch.inside, batch.labels] += 1
        delta[batch.outside] = 0
        delta = delta.reshape(t, b, N)
        heard = np.zeros((t, b, len(OFFSETS), N), np.float32)
        for o in OFFSETS:
            heard[max(0, o) : max(0, t + o), :, _PLACE[o]] = delta[max(0, -o) : max(0, t - o)]
        by_row = batch.by_row(heard.reshape(t * b, -1))
        _moved(near, near2, by_row[:, :near_n].copy(), batch.near_use, b, rate, l2)
        _moved(own, own2, by_row[:, near_n:].copy(), batch.own_use, b, rate, l2)
        tg = np.zeros_like(self.trans)
        if len(batch.behind):
            behind, ahead = fwd.reshape(t * b, N).take(batch.behind, axis=0), (at * back).reshape(t * b, N).take(batch.ahead, axis=0)
            z = ((behind @ step) * ahead).sum(axis=1, keepdims=True)
            tg -= ((behind / z).T @ ahead) * step
            np.add.at(tg.reshape(-1), batch.steps, 1)
        tg /= b
        t2 += tg * tg
        self.trans += (rate * tg / np.sqrt(t2)).astype(np.float32)

    # -- use -------------------------------------------------------------------

    def _rare_parts(self, word: str) -> tuple[tuple[str, ...], tuple[set[str], ...]]:
        """The rare parts of a word that links join if equal, and the forms of those that links join if alike."""
        if word not in self._rare:
            if len(self._rare) > 20_000:
                self._rare.clear()
            parts = word.lower().split("-")
            bare = [b for p in parts if p not in self.common and len(b := re.sub(r"['’]s?$", "", p)) >= LEAST_LETTERS and b not in self.common]
            self._rare[word] = tuple(p for p in parts if len(p) > 3 and p not in self.common), tuple({b, *(b[:k] + b[k + 1 :] for k in range(len(b)))} for b in bare)
        return self._rare[word]

    def skips(self, toks: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
        """Links between each rare word, or part of one, and its occurrence before."""
        seen: dict[str, int] = {}
        out = []
        for i, t in enumerate(toks):
            if t[3] == "word":
                for part in self._rare_parts(t[0])[0]:
                    j = seen.get(part)
                    if j is not None and j != i:
                        out.append((j, i))
                    seen[part] = i
        return out

    def similar(self, toks: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
        """Links between each rare word and the last before that is like it but for an ending or one letter."""
        seen: dict[str, int] = {}
        out = []
        for i, t in enumerate(toks):
            if t[3] == "word":
                for forms in self._rare_parts(t[0])[1]:
                    near = [seen[f] for f in forms if f in seen]
                    if near and (j := max(near)) != i and toks[j][0].lower() != t[0].lower():
                        out.append((j, i))
                    seen.update(dict.fromkeys(forms, i))
        return out

    def tune(self, texts: list[list[tuple[str, str | None]]]) -> None:
        """Sets the strengths of links to those that label the most tokens of labelled texts right; of equals the weaker."""
        made = [(labelled(p), case_of("".join(t for t, _ in p))) for p in texts]
        made = [(toks, y, case) for (toks, y), case in made if toks]
        links, near = [self.skips(t) for t, _, _ in made], [self.similar(t) for t, _, _ in made]
        keep = [i for i in range(len(made)) if links[i] or near[i]]
        us = self.unaries_of([(made[i][0], made[i][2]) for i in keep])

        def right(skip: float, similar: float) -> int:
            self.skip, self.skip_similar = skip, similar
            got = self.label(us, [links[i] for i in keep], [near[i] for i in keep])
            return sum(int((g == np.array(made[i][1])).sum()) for g, i in zip(got, keep, strict=True))

        best = max(STRENGTHS, key=lambda s: (right(s, 0.0), -s))
        also = max(STRENGTHS, key=lambda s: (right(best, s), -s))
        self.skip, self.skip_similar = best, also

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each occurrence in each text, in order."""
        toks = [tokens(t) for t in texts]
        us = self.unaries_of([(k, case_of(t)) for k, t in zip(toks, texts, strict=True)])
        labels = self.label(us, [self.skips(k) for k in toks], [self.similar(k) for k in toks])
        out = []
        for some, y in zip(toks, labels, strict=True):
            found: list[list] = []
            for t, lab in zip(some, y.tolist(), strict=True):
                if LABELS[lab][0] == "B":
                    found.append([KIND_OF[lab], t[1], t[2]])
                elif lab:
                    found[-1][2] = t[2]
            out.append([tuple(f) for f in found])
        return out


def labelled(pieces: list[tuple[str, str | None]]) -> tuple[list[tuple[str, int, int, str]], list[int]]:
    """Tokens and labels of a text given in pieces; a token across pieces has the label of its larger part."""
    text = "".join(p[0] for p in pieces)
    owner = [i for i, p in enumerate(pieces) for _ in p[0]]
    toks = tokens(text)
    labels, last = [], -1
    for t in toks:
        i = owner[t[1]]
        if i != owner[t[2] - 1]:
            i = Counter(owner[t[1] : t[2]]).most_common(1)[0][0]
        kind = pieces[i][1]
        if kind is None or (kind == "email" and t[3] == "sign"):
            labels.append(0)
            last = last if kind else -1
        else:
            labels.append(LABELS.index(("I-" if i == last else "B-") + kind))
            last = i
    return toks, labels


_CLAUSES = re.compile(r"(?<=[.?!;])\s+|\n+")


_NINES = re.compile(r"(?<=\d)\d|(?<=\d[-./])\d|[1-9]")
#: White space that no token can hold or end at: beside neither digits nor brackets, or between a digit and a longer word.
_GAPS = re.compile(r"(?<![\d()\[\]\s])\s+(?![\d()\[\]\s])|(?<=[^\W\d_]{4})(?<!poste)\s+(?=\d)|(?<=\d)\s+(?!poste)(?=[^\W\d_]{4})", re.I)


def clauses_of(text: str) -> list[str]:
    """The distinct clauses of a text, in order."""
    return sorted({c.strip() for c in _CLAUSES.split(text)} - {""})


def bare(clause: str) -> str:
    """The clause with one space for each gap and nines for digits: what has other digits or gaps, but the same features, is equal."""
    return _GAPS.sub(" ", _NINES.sub("9", clause))


def copy_key(clauses: list[str]) -> bytes:
    """Equal for texts whose clauses differ in signs, gaps and letter case only."""
    return blake2b(re.sub(r"\W+", " ", " ".join(clauses).lower()).encode("utf-8", "surrogatepass"), digest_size=16).digest()


@lru_cache(maxsize=100_000)
def _words(clause: str) -> tuple[str, ...]:
    """The words of a clause; whatever holds digits or is a mail address becomes '0'."""
    return tuple(t if kind == "word" else "0" for t, _, _, kind in tokens(clause) if kind != "sign")


@lru_cache(maxsize=100_000)
def _pairs(clause: str) -> tuple[tuple[str, str], ...]:
    some = ["^", *(w.lower() for w in _words(clause)), "$"]
    return tuple(zip(some, some[1:], strict=False))


def tally(texts: Iterable[tuple[bytes, str]], held: int = HELD_COUNTS) -> Iterator[tuple[Counter, Counter]]:
    """Counts over texts that come with their copy_key, in the order of both; of copies the first counts.

    The first counter has in how many texts each pair stands ("pair"), each
    word of texts of mixed case is written small ("small"), and how many texts
    there are ("texts"); and every clause in its bare form ("clause"). The second has in
    how many texts of mixed case a word isn't written small ("small").
    """
    n: Counter = Counter()
    large: Counter = Counter()
    last = None
    for key, text in texts:
        clauses = {bare(c) for c in clauses_of(text)}
        n.update(dict.fromkeys((("clause", c, "") for c in clauses), 0))
        if key != last:
            last = key
            n["texts", "", ""] += 1
            n.update(("pair", *p) for p in {p for c in clauses for p in _pairs(c)})
            if case_of(text) == "m":
                words = {w for c in clauses for w in _words(c)}
                n.update(("small", w, "") for w in words if w.islower())
                large.update({("small", w.lower(), "") for w in words if not w.islower()})
        if len(n) + len(large) > held:
            yield n, large
            n, large = Counter(), Counter()
    yield n, large


def least(texts: int, frequent: int = FREQUENT) -> int:
    """In how many of so many texts a pair or word stands at least to be ordinary."""
    return max(frequent, -(-texts // ONE_IN))


def _mostly_small(small: int, large: int) -> bool:
    return small > 1.5 * large


def is_ordinary(clause: str, pairs: set[tuple[str, str]], small: set[str]) -> bool:
    """Whether all pairs of a clause are among ``pairs``, or made of words among ``small``."""
    return len(clause) > 8 and all(p in pairs or (p[0] in small and p[1] in small) for p in _pairs(clause))


_ENDS = {"^", "$", "0"}


def background(texts: list[str], frequent: int = FREQUENT) -> tuple[list[str], set[str]]:
    """Ordinary clauses in their bare form, and words that are mostly written small.

    A clause is ordinary if each of its pairs of neighbouring words stands in
    at least so many texts and one of ``ONE_IN`` (copies counting once), or is made of two words that
    are mostly written small; a clause that names someone has a pair that isn't.
    """
    n, large = next(tally(sorted({(copy_key(clauses_of(t)), t) for t in texts}), held=1 << 62))
    enough = least(n["texts", "", ""], frequent)
    pairs = {k[1:] for k, v in n.items() if k[0] == "pair" and v >= enough}
    small = {k[1] for k, v in n.items() if k[0] == "small" and v >= enough and _mostly_small(v, large[k])}
    return sorted(k[1] for k in n if k[0] == "clause" and is_ordinary(k[1], pairs, small | _ENDS)), small


COUNTS = "what string, a string, b string, n long, large long"


def background_of(frames: list[DataFrame], frequent: int = FREQUENT) -> tuple[DataFrame, set[str]]:
    """``background`` of all texts of the frames (one text column each), counted in parallel; the clauses stay a frame.

    What is sent to the driver and broadcast, pairs and words, is bounded by ``ONE_IN``.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            some = {t.translate(_INVISIBLE) for t in frame["clause"].unique()}
            yield pd.DataFrame([(copy_key(clauses_of(t)), t) for t in some], columns=["key", "text"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((k, t) for frame in batches for k, t in zip(frame["key"], frame["text"], strict=True))
        for n, large in tally(rows):
            yield pd.DataFrame([(*k, n[k], large[k]) for k in n.keys() | large.keys()], columns=["what", "a", "b", "n", "large"])

    columns = [df.select(F.col(f"`{df.columns[0]}`").alias("clause")).where("clause IS NOT NULL") for df in frames]
    texts = spread(functools.reduce(DataFrame.unionAll, columns)).mapInPandas(keyed, "key binary, text string")
    partial = spread(texts, "key").sortWithinPartitions("key", "text").mapInPandas(counted, COUNTS)
    counts = materialise(partial.groupBy("what", "a", "b").agg(F.sum("n").alias("n"), F.sum("large").alias("large")), "words")
    of = lambda what: counts.where(F.col("what") == what)
    enough = least(sum(r["n"] for r in of("texts").collect()), frequent)
    pairs = {(r["a"], r["b"]) for r in of("pair").where(F.col("n") >= enough).collect()}
    small = {r["a"] for r in of("small").where(F.col("n") >= enough).collect() if _mostly_small(r["n"], r["large"])}
    held = counts.sparkSession.sparkContext.broadcast((pairs, small | _ENDS))

    def ordinary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[[is_ordinary(c, *held.value) for c in frame["clause"]]]

    clauses = of("clause").select(F.col("a").alias("clause"))
    return materialise(spread(clauses).mapInPandas(ordinary, "clause string"), "ordinary"), small


def _sentences(sentences: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """The training sentences the first field sees, and those kept apart."""
    split = {lang: lines.split("\n") for lang, lines in sentences.items()}
    seen = {lang: "\n".join(x for i, x in enumerate(some) if i % KEPT_APART or len(some) < KEPT_APART) for lang, some in split.items()}
    return seen, {lang: "\n".join(some[::KEPT_APART]) for lang, some in split.items()}


def _common(clause_words: set[str], small: set[str], n_texts: int, seed: int, sentences: dict[str, str]) -> set[str]:
    """Ordinary words: those of ordinary clauses, those mostly written small, and those that come again in what else stands in invented texts."""
    maker = Maker(seed, sentences)
    words = Counter(w.lower() for _ in range(n_texts) for t, k in maker.text(["."]) if k is None for w in _words(t))
    return clause_words | small | {w for w, c in words.items() if c >= 3}


def _trained(clauses: list[str], common: set[str], n_texts: int, seed: int, sentences: dict[str, str]) -> Field:
    """A field trained on so many invented texts among clauses, or more until each clause stands in one."""
    maker = Maker(seed, sentences)
    made = [maker.text(clauses) for _ in range(n_texts)]
    while not maker.dealt_all(clauses):
        made.append(maker.text(clauses))
    field = Field(common)
    field.train(made)
    return field


def _tuned(field: Field, clauses: list[str], seed: int, apart: dict[str, str]) -> None:
    maker = Maker(seed + 1_000, apart, vary=True)
    field.tune([maker.text(clauses) for _ in range(DEVELOPMENT_TEXTS)])


def fit(texts: list[str], n_texts: int = TRAINING_TEXTS, frequent: int = FREQUENT, seed: int = 1, sentences: dict[str, str] = SENTENCES) -> Field:
    """A field trained on invented texts among the ordinary clauses of ``texts``, each of which stands in one at least.

    A first field, trained with clauses that hold no numbers or codes, tells
    which clauses with such are ordinary too, as it finds nothing in them; the second is trained with all.
    The first sees but a part of ``sentences``: on texts made of the others, in
    which names come again, also in other forms, the strengths of links are
    learned.
    """
    ordinary, small = background(texts, frequent)
    seen, apart = _sentences(sentences)
    plain = [c for c in ordinary if "0" not in _words(c)]
    first = _trained(plain, _common({w.lower() for c in plain for w in _words(c)}, small, n_texts // 2, seed, seen), n_texts // 2, seed, seen)
    _tuned(first, plain, seed, apart)
    clauses = [c for c, f in zip(ordinary, first.find(ordinary), strict=True) if not f]
    field = _trained(clauses, _common({w.lower() for c in clauses for w in _words(c)}, small, n_texts, seed, sentences), n_texts, seed, sentences)
    field.skip, field.skip_similar = first.skip, first.skip_similar
    return field


def _mixed(clauses: DataFrame, small: set[str], n_texts: int, seed: int, sentences: dict[str, str], part: int) -> Field:
    """A field trained among all clauses of a frame: one for each part of so many clauses, their weights averaged.

    The likelihood has one maximum, to which each part's weights come near; a
    feature that a part hasn't seen has weight 0 there. Weights are summed as
    whole numbers, so that the order of parts doesn't matter.
    """
    spark = clauses.sparkSession

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"clause": sorted({w.lower() for frame in batches for c in frame["clause"] for w in _words(c)})}, dtype=object)

    words = {r[0] for r in spread(clauses).mapInPandas(told, "clause string").distinct().collect()}
    common = _common(words, small, n_texts, seed, sentences)
    n = clauses.count()
    if n <= part:
        return _trained(sorted(r[0] for r in clauses.collect()), common, n_texts, seed, sentences)
    parts = -(-n // part)
    held = spark.sparkContext.broadcast((common, sentences))
    columns = [f"w{i}" for i in range(N)]

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = sorted(c for frame in batches for c in frame["clause"])
        if some:
            field = _trained(some, held.value[0], n_texts, seed + int.from_bytes(copy_key(some[:1])[:4]), held.value[1])
            keys = [*field.ids, *((len(OFFSETS), str(i)) for i in range(N))]
            rows = np.rint(np.concatenate([field.weights, field.trans]).astype(float) * SCALE).astype(np.int64)
            for i in range(0, len(keys), 20_000):
                frame = pd.DataFrame(rows[i : i + 20_000], columns=columns)
                frame.insert(0, "f", [k[1] for k in keys[i : i + 20_000]])
                frame.insert(0, "o", [k[0] for k in keys[i : i + 20_000]])
                yield frame

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = pd.concat([pd.DataFrame(columns=["o", "f", *columns]), *batches]).sort_values(["o", "f"])
        mean = (some[columns].to_numpy(np.float64) / (SCALE * parts)).astype("<f4")
        yield pd.DataFrame({"features": [json.dumps([some["o"].tolist(), some["f"].tolist()])], "weights": [mean.tobytes()]})

    sums = clauses.repartition(parts, "clause").mapInPandas(trained, ", ".join(["o int", "f string", *(f"{c} long" for c in columns)]))
    total = sums.repartition(parts, "o", "f").groupBy("o", "f").agg(*(F.sum(c).alias(c) for c in columns))
    field, blocks = Field(common), []
    for row in materialise(total.mapInPandas(packed, "features string, weights binary"), "weights").orderBy("features").toLocalIterator():
        block = np.frombuffer(bytes(row["weights"]), "<f4").reshape(-1, N)
        own = []
        for i, (o, f) in enumerate(zip(*json.loads(row["features"]), strict=True)):
            if o == len(OFFSETS):
                field.trans[int(f)] = block[i]
            else:
                own.append(i)
                field.ids[o, f] = len(field.ids)
        blocks.append(block[own])
    field.weights = np.concatenate(blocks)
    return field


def save(spark: SparkSession, field: Field, path: str) -> None:
    """Keeps a fitted field as a table of one row, so that it is fitted once and used by many runs."""
    told = {"common": sorted(field.common), "features": [[o, f] for o, f in field.ids], "skip": field.skip, "similar": field.skip_similar}
    row = (json.dumps(told), bytearray(field.weights.astype("<f4").tobytes()), bytearray(field.trans.astype("<f4").tobytes()))
    spark.createDataFrame([row], "told string, weights binary, transitions binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Field:
    """The field that ``save`` kept."""
    row = spark.read.parquet(path).head()
    told = json.loads(row["told"])
    field = Field(set(told["common"]))
    field.ids = {(o, f): i for i, (o, f) in enumerate(told["features"])}
    field.weights = np.frombuffer(bytes(row["weights"]), "<f4").reshape(-1, N).copy()
    field.trans = np.frombuffer(bytes(row["transitions"]), "<f4").reshape(N, N).copy()
    field.skip, field.skip_similar = told["skip"], told["similar"]
    return field


def fit_on(frames: list[DataFrame], n_texts: int = TRAINING_TEXTS, frequent: int = FREQUENT, seed: int = 1, part: int = PART) -> Field:
    """``fit`` with all texts of the frames (one text column each): counted and trained in parallel, by parts of so many clauses."""
    ordinary, small = background_of(frames, frequent)
    seen, apart = _sentences(SENTENCES)
    numbered = F.udf(lambda c: "0" in _words(c), "boolean", useArrow=True)
    plain = materialise(ordinary.where(~numbered("clause")), "plain")
    first = _mixed(plain, small, n_texts // 2, seed, seen, part)
    _tuned(first, [r[0] for r in plain.orderBy(F.xxhash64("clause"), "clause").limit(part).collect()], seed, apart)
    clauses = materialise(find(spread(ordinary), "clause", first).where(F.size("found") == 0).select("clause"), "clauses")
    strengths = first.skip, first.skip_similar
    del first  # the driver holds one field at a time
    field = _mixed(clauses, small, n_texts, seed, SENTENCES, part)
    field.skip, field.skip_similar = strengths
    return field


FOUND = "array<struct<kind string, start int, stop int>>"


def find(df: DataFrame, text: str, field: Field, column: str = "found") -> DataFrame:
    """``df`` with an array of the occurrences in each text: kind, start, end.

    A null or empty text has an empty array. Positions count characters of the
    text without invisible characters (see ``redact``).
    """
    held = df.sparkSession.sparkContext.broadcast(field)  # as large as the distinct features of its training texts

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            distinct = list(dict.fromkeys(t for t in s if t))
            known: dict[str, list] = {}
            for i in range(0, len(distinct), 1000):
                part = distinct[i : i + 1000]
                found = held.value.find([t.translate(_INVISIBLE) for t in part])
                known |= {t: [dict(zip(("kind", "start", "stop"), x, strict=True)) for x in f] for t, f in zip(part, found, strict=True)}
            yield pd.Series([known[t] if t else [] for t in s], dtype=object)

    return df.withColumn(column, run.asNondeterministic()(F.col(f"`{text}`")))


def replace(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each occurrence replaced by its kind in brackets."""
    out, end = [], 0
    for kind, a, b in found:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text: str, field: Field, column: str = "redacted") -> DataFrame:
    """``df`` with each text's personal information replaced by ``[EMAIL]``, ``[NAME]`` and so on.

    The rest stays as it is, but for invisible characters. Null stays null.
    """
    held = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            bare = [t.translate(_INVISIBLE) if t else "" for t in s]
            found = held.value.find(bare)
            yield pd.Series([None if t is None else replace(b, f) for t, b, f in zip(s, bare, found, strict=True)], dtype=object)

    return df.withColumn(column, run.asNondeterministic()(F.col(f"`{text}`")))
