"""Languages of documents and of the stretches of mixed ones, by rank-order profiles.

A language's profile ranks its n-grams by frequency. A text is compared to each
profile by the out-of-place distance of its own most frequent n-grams: the sum
of the differences in rank, an n-gram that a profile lacks counting as beyond
its end. For a single word, whose n-grams all have the first rank, this is the
mean rank of its n-grams in the profile; a cheapest path through these costs,
with a price for each change of language, finds the stretches, and every
stretch is then compared to the profiles as a text of its own.

Profiles are fitted on a bounded sample of labelled rows; labels may be wrong
and texts mixed, so it is fitted again on the stretches that agree with their
label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.canonical import _INVISIBLE
from quernel.llm.sampling import bounded_sample

#: Labelled rows that profiles are fitted on at most, taken in the order of a hash.
SAMPLE_ROWS = 20_000
PROFILE_SIZE = 3000
GRAMS = (1, 2, 3, 4, 5)
ROUNDS = 3
#: Texts that another language than those of NAMES must be the label of, where languages aren't given.
LEAST_TEXTS = 20
#: Price of changing the language between two words: within a clause, after a comma, after a clause.
CHANGE = (2.5, 1.6, 0.55)
#: A stretch less sure than this, or of fewer words, is no stretch of its own (names, codes): it belongs to its neighbour.
LEAST_SURE = 0.3
LEAST_WORDS = 2
CACHED_WORDS = 200_000

# Names of the languages, by which labels are read.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês inglese engels",
    "de": "de deu ger german deutsch allemand alemán aleman alemão tedesco duits",
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francês francese frans",
    "es": "es spa spanish spanisch espagnol español espanol castellano castilian espanhol spagnolo spaans",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português portoghese portugees",
    "it": "it ita italian italienisch italien italiano italiaans",
    "nl": "nl nld dut dutch niederländisch niederlaendisch néerlandais neerlandais neerlandés neerlandes neerlandês holandés holandês olandese nederlands flemish",
}
# Labels that name no language.
NO_LANGUAGE = "und not no unknown undetermined undefined unspecified missing empty default n/a na nan none null nil mul mis zxx xx ? - -- --- . auto other any tbd language lang"

_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}
_PLACEHOLDERS = set(NO_LANGUAGE.split()) | {""}


def read_label(label: str | None) -> str | None:
    """The language a label names: a code of NAMES, the label itself for another language, None for no language."""
    if label is None:
        return None
    bare = label.translate(_INVISIBLE).strip().casefold()
    if bare in _PLACEHOLDERS:
        return None
    whole = _BY_NAME.get(bare)
    if whole:
        return whole
    pieces = [p for p in re.split(r"[-_\s(),;/]+", bare) if p]
    if not pieces or pieces[0] in _PLACEHOLDERS:
        return None
    if pieces[0] in _BY_NAME:
        return _BY_NAME[pieces[0]]
    # "Brazilian Portuguese": a name further on counts, a code of two letters there is a country's.
    return next((_BY_NAME[p] for p in pieces[1:] if len(p) > 3 and p in _BY_NAME), pieces[0])


# What holds no words: pieces between spaces that are addresses of mails or pages, or hold a digit or a sign inside.
_PIECE = re.compile(r"\S+")
_CODED = re.compile(r"[@#\\=<>\d_]|\w\.\w|https?:")
_WORD = re.compile(r"[^\W\d_]+['’]?")
_CLAUSE = re.compile(r"[.?!;:…|/\n–—()\"“”«»？]")


def words(text: str) -> list[tuple[str, int, int, int]]:
    """(word in lower case, start, end, change) of the text; change tells what lies before: 0 nothing, 1 a comma, 2 a clause's end or code."""
    plain = _PIECE.sub(lambda m: "\x00" * len(m[0]) if _CODED.search(m[0]) else m[0], text)
    out = []
    end = 0
    for m in _WORD.finditer(plain):
        between = plain[end : m.start()]
        change = 2 if "\x00" in between or _CLAUSE.search(between) else int("," in between)
        w = m[0].casefold().replace("’", "'")
        out.append((w, m.start(), m.end(), change))
        end = m.end()
    return out


def grams(word: str) -> list[str]:
    """The n-grams of a word with its bounds marked, and the whole word."""
    s = f"_{word}_"
    out = [s[i : i + n] for n in GRAMS for i in range(len(s) - n + 1) if not (n == 1 and s[i] == "_")]
    if len(s) > GRAMS[-1]:
        out.append(s)
    return out


class Profiles:
    """Rank-order profiles of languages."""

    def __init__(self, counts: dict[str, Counter], size: int = PROFILE_SIZE) -> None:
        self.langs = sorted(counts)
        self.size = size
        self.ranks: dict[str, np.ndarray] = {}
        for i, lang in enumerate(self.langs):
            ordered = sorted(counts[lang].items(), key=lambda kv: (-kv[1], kv[0]))[:size]
            for rank, (gram, _) in enumerate(ordered):
                row = self.ranks.get(gram)
                if row is None:
                    row = self.ranks[gram] = np.full(len(self.langs), float(size), np.float32)
                row[i] = rank
        self.beyond = np.full(len(self.langs), float(size), np.float32)
        # Numbers of the profiles' n-grams, in their order, and their ranks by number; the last row is that of all others.
        self.numbers = {gram: i for i, gram in enumerate(sorted(self.ranks))}
        self.table = np.array([*(self.ranks[g] for g in self.numbers), self.beyond], np.float32).reshape(len(self.numbers) + 1, len(self.langs))
        self._seen: dict[str, np.ndarray] = {}
        self._grams: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}, "_grams": {}}

    def gram_numbers(self, word: str) -> np.ndarray:
        """Numbers of a word's n-grams; those of n-grams in no profile are beyond all others, by hash."""
        found = self._grams.get(word)
        if found is None:
            k, at = len(self.numbers), self.numbers
            found = np.array([at[g] if g in at else k + zlib.crc32(g.encode("utf-8", "replace")) for g in grams(word)], np.int64)
            if len(self._grams) >= CACHED_WORDS:
                self._grams.clear()
            self._grams[word] = found
        return found

    def word_cost(self, word: str) -> np.ndarray:
        """The out-of-place distance of a word for each language, from 0 to 1 for each n-gram."""
        cost = self._seen.get(word)
        if cost is None:
            rows = [self.ranks.get(g, self.beyond) for g in grams(word)]
            cost = np.mean(rows, axis=0) / self.size
            if len(self._seen) >= CACHED_WORDS:
                self._seen.clear()
            self._seen[word] = cost
        return cost

    def distance(self, some: list[str]) -> np.ndarray:
        """The out-of-place distance of a text's words for each language, from 0 to 1; n-grams of one frequency rank in the order of their numbers."""
        if not some:
            return np.ones(len(self.langs))
        found, counts = np.unique(np.concatenate([self.gram_numbers(w) for w in some]), return_counts=True)
        ordered = found[np.argsort(-counts, kind="stable")][: self.size]
        rows = self.table[np.minimum(ordered, len(self.numbers))]
        own = np.arange(len(ordered), dtype=np.float32)[:, None]
        out = np.where(rows >= self.size, self.size, np.abs(rows - own))
        return out.mean(axis=0) / self.size

    def stretches(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(language, confidence, start, end, words) of each longest stretch in one language, in order of reading."""
        return self.stretches_of(words(text.translate(_INVISIBLE)))

    def stretches_of(self, found: list[tuple[str, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        """The same for a text's words."""
        if not self.langs:
            return []
        known = [w for w in found if self.word_cost(w[0]).min() < 0.97]
        if not known:
            return []
        costs = np.array([self.word_cost(w[0]) for w in known])
        whole = costs.sum(axis=0)
        if whole.min() - costs.min(axis=1).sum() <= CHANGE[2]:  # no change can pay
            path = [int(whole.argmin())] * len(known)
        else:
            path = self._cheapest(costs, [w[3] for w in known])
        out: list[list] = []
        for w, lang in zip(known, path, strict=True):
            if out and out[-1][0] == lang:
                out[-1][1].append(w)
            else:
                out.append([lang, [w]])
        return self._named(out)

    def _cheapest(self, costs: np.ndarray, changes: list[int]) -> list[int]:
        total = costs[0].copy()
        back = np.zeros(costs.shape, np.int16)
        here = np.arange(costs.shape[1])
        for t in range(1, len(costs)):
            best = int(total.argmin())
            moved = total[best] + CHANGE[changes[t]]
            stay = total <= moved
            back[t] = np.where(stay, here, best)
            total = np.where(stay, total, moved) + costs[t]
        path = [int(total.argmin())]
        for t in range(len(costs) - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]

    def _judge(self, some: list[tuple]) -> tuple[int, float]:
        d = self.distance([w[0] for w in some])
        first = int(d.argmin())
        second = float(np.partition(d, 1)[1]) if len(d) > 1 else 1.0
        return first, (1.0 - float(d[first]) / second if second else 0.0)

    def _named(self, parts: list[list]) -> list[tuple[str, float, int, int, int]]:
        judged = [(*self._judge(some), some) for _, some in parts]
        if len(judged) > 1:
            clear = [j for j in judged if j[1] >= LEAST_SURE and len(j[2]) >= LEAST_WORDS]
            judged = clear or [max(judged, key=lambda j: (len(j[2]), j[1]))]
        joined: list[list] = []
        for lang, sure, some in judged:
            if joined and joined[-1][0] == lang:
                joined[-1][2] = joined[-1][2] + some
                joined[-1][1] = self._judge(joined[-1][2])[1]
            else:
                joined.append([lang, sure, some])
        return [(self.langs[lang], float(sure), some[0][1], some[-1][2], len(some)) for lang, sure, some in joined]


def fit(rows: list[tuple[str, str]], size: int = PROFILE_SIZE, rounds: int = ROUNDS) -> Profiles:
    """Profiles of all languages of (text, language) pairs, some of them wrong or mixed."""
    read = [(words(text.translate(_INVISIBLE)), lang) for text, lang in rows]

    def of(pick) -> Profiles:
        spoken: dict[str, Counter] = {lang: Counter() for _, lang in rows}
        for found, lang in read:
            spoken[lang].update(pick(found, lang))
        counts: dict[str, Counter] = {lang: Counter() for lang in spoken}
        for lang, some in spoken.items():
            for w, n in some.items():
                for g in grams(w):
                    counts[lang][g] += n
        return Profiles({k: c for k, c in counts.items() if c}, size)

    profiles = of(lambda found, lang: [w[0] for w in found])
    for _ in range(rounds - 1):
        before = profiles

        def agreeing(found: list[tuple[str, int, int, int]], lang: str, before: Profiles = before) -> list[str]:
            parts = [s for s in before.stretches_of(found) if s[0] == lang]
            return [w for w, a, b, _ in found if any(s[2] <= a and b <= s[3] for s in parts)]

        profiles = of(agreeing)
    return profiles


def fit_on(df: DataFrame, text: str, label: str, sample_rows: int = SAMPLE_ROWS, languages: set[str] | None = None) -> Profiles:
    """Profiles fitted on at most ``sample_rows`` distinct labelled texts, in the order of their hash.

    Of ``languages``; without it, of those of ``NAMES`` and of every other that
    at least ``LEAST_TEXTS`` texts of the sample are labelled with.
    """
    pairs = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label")).where("text is not null and label is not null")
    rows = [(r["text"], lang) for r in bounded_sample(pairs, sample_rows) if (lang := read_label(r["label"])) is not None]
    if languages is None:
        languages = {lang for lang, n in Counter(lang for _, lang in rows).items() if lang in NAMES or n >= LEAST_TEXTS}
    return fit([(t, lang) for t, lang in rows if lang in languages])


SEGMENTS = "array<struct<lang string, confidence double, start int, stop int, n_words int>>"


def detect(df: DataFrame, text: str, profiles: Profiles, column: str = "stretches") -> DataFrame:
    """``df`` with an array of the stretches of each text: language, confidence, start, end and number of words.

    Positions count in the text without invisible characters. A null, empty or
    wordless text has an empty array. (The function is marked nondeterministic
    so that filters on its result don't evaluate it twice.)
    """
    held = df.sparkSession.sparkContext.broadcast(profiles)  # bounded by languages x PROFILE_SIZE

    @F.pandas_udf(SEGMENTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = held.value
        seen: dict[str, list] = {}
        for s in batches:
            out = []
            for t in s:
                got = seen.get(t) if t is not None else []
                if got is None:
                    got = [dict(zip(("lang", "confidence", "start", "stop", "n_words"), x, strict=True)) for x in p.stretches(t)]
                    if len(t) < 2000:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[t] = got
                out.append(got)
            yield pd.Series(out, dtype=object)

    return df.withColumn(column, run.asNondeterministic()(F.col(f"`{text}`")))


@F.pandas_udf(T.StringType())
def label_language(s: pd.Series) -> pd.Series:
    """``read_label`` of a column."""
    known = {x: read_label(x) for x in s.unique() if x is not None}
    return s.map(lambda x: known.get(x))
