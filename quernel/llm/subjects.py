"""Subject areas of documents, by a seeded non-negative factorisation.

The document-term matrix V is factored as W x H with multiplicative updates
(Kullback-Leibler divergence), alternating between the rows of W, which every
partition solves for its own documents, and H, whose update is a sum over all
documents. Component k is anchored to subject k: H starts from the terms in
which documents labelled k, and the subject's description, differ from the
whole corpus, and while the first updates run labelled documents may only use
their own subjects and the common background. A row of W is then the document's
mixture of subjects. The rows of W of single sentences, solved in the same way
from the document's row on, tell what each is about, and their count a
document's subjects.

Terms are words and pairs of neighbouring words, kept as 64-bit hashes; V has
a column for each term of the labelled documents (a bounded sample of them) and
of the descriptions, as no other term can tell subjects apart from the labels
on. So H has a bound that doesn't grow with the corpus. Texts are read once:
what fits and what assigns works on the same table of term numbers by sentence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm.canonical import _INVISIBLE
from quernel.workspace import materialise

#: Labelled documents, in the order of a hash, whose terms and labels count.
LABELLED = 20_000
#: A term is used if it stands in at least so many documents of the corpus.
LEAST_DOCUMENTS = 3
UPDATES = 6
#: Updates during which labelled documents are held to their labels.
ANCHORED = 3
INNER = 4
#: Updates of a sentence's row: with few terms, more of them only sharpen what the first has said.
SENTENCE_ROUNDS = 1
#: Weight of a subject not among a document's labels while it is anchored: labels may be wrong.
OFF_LABEL = 0.02
#: Labelled documents that decide whether a term tells subjects apart, and the least share of its use that one subject must then have.
DECIDED = 8
TELLING = 0.35
#: A term that too few labelled documents have is general, not a subject's, if it stands in this share of the documents of one group
#: (such as a language) of at least so many documents; so many groups, the largest, are looked at.
GENERAL = 0.08
GROUP_DOCUMENTS = 25
MOST_GROUPS = 64
#: Terms that tell less than this are not looked at in sentences.
LEAST_TELLING = 0.02
#: Documents whose rows of V are held at a time, and characters of text read at a time.
AT_ONCE = 2_000
CHARACTERS = 2_000_000
#: A subject belongs to a document if at least this share of its sentences is about it.
SHARE = 0.2
#: Least evidence, in terms, for a sentence to be about a subject.
EVIDENCE = 0.4
#: Words whose hashes a worker keeps.
CACHED = 500_000

_FENCE = re.compile(r"```.*?(?:```|$)", re.S)
_SENTENCE = re.compile(r"(?<=[.!?。])[\s\"'»”)]+|\n\s*\n|\n(?=\s*(?:[-*#>]|\d+\.)\s)|\n+")
_TERM = re.compile(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?")
_UNSEEN = re.compile("[" + "".join(map(re.escape, map(chr, sorted(_INVISIBLE)))) + "]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def sentences(text: str) -> list[str]:
    """The sentences of a text, without code blocks and headings."""
    plain = text if text.isascii() else _UNSEEN.sub("", text)
    if "```" in plain:
        plain = _FENCE.sub("\n\n", plain)
    return [s for p in _SENTENCE.split(plain) if (s := p.strip()) and not s.startswith("#") and _TERM.search(s)]


class _Hashes(dict):
    """Word in lower case to its hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        return h


_hash_of = _Hashes()


def hashed(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of some texts, and the text that each is of, in order of texts."""
    words = [_TERM.findall(p.casefold()) for p in parts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    one = np.fromiter(map(_hash_of.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    of = np.repeat(np.arange(len(parts)), n)
    together = np.flatnonzero(of[1:] == of[:-1])
    two = (one[together] * _MIX + one[together + 1]) * _MIX
    where = np.concatenate([of, of[together]])
    order = np.argsort(where, kind="stable")
    return np.concatenate([one, two])[order], where[order]


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column one after the other, and the lists' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rows_of(ids: np.ndarray, lengths: np.ndarray) -> Batch:
    return Batch(len(lengths), np.repeat(np.arange(len(lengths)), lengths), ids.astype(np.int64))


class Vocabulary:
    """The terms that have columns, by hash."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.hashes)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The column of each hash; -1 for others."""
        if not hasattr(self, "_mask"):
            self._mask = np.zeros(1 << _BITS, bool)
            self._mask[self.hashes & np.uint64((1 << _BITS) - 1)] = True
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self._mask[h & np.uint64((1 << _BITS) - 1)])
        if len(maybe):
            some = h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == some, at, -1)
        return out

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the columns of its terms, sentence by sentence and those of code last, and how many each sentence has."""
        parts, sizes, coded = [], [], []
        for t in texts:
            some = sentences(t) if t else []
            code = _FENCE.findall(t) if t and "```" in t else []
            parts += some + code
            sizes.append(len(some))
            coded.append(len(code))
        h, of = hashed(parts)
        ids = self.numbers(h)
        kept = ids >= 0
        ids, each = ids[kept], np.bincount(of[kept], minlength=len(parts))
        ends = np.concatenate([[0], np.cumsum(each)])
        out, counts, at = [], [], 0
        for s, c in zip(sizes, coded, strict=True):
            out.append(ids[ends[at] : ends[at + s + c]])
            counts.append(each[at : at + s].astype(np.int32))
            at += s + c
        return out, counts


def _chunks(texts: pd.Series) -> Iterator[list]:
    """The texts in order, so many at a time that their characters are bounded (single texts may be longer)."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t) if t else 0
        if size > CHARACTERS:
            yield some
            some, size = [], 0
    if some:
        yield some


def labelled_documents(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, labels of at most ``LABELLED`` documents with a known label."""
    known = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)


def vocabulary(docs: DataFrame, key: str, text: str, known: DataFrame, descriptions: list[str]) -> Vocabulary:
    """The terms of the labelled documents and of the descriptions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(0, np.uint64)
        for pdf in batches:
            for some in _chunks(pdf["text"]):
                parts = [p for t in some if t for p in (*sentences(t), *_FENCE.findall(t))]
                seen = np.union1d(seen, hashed(parts)[0])
        for i in range(0, len(seen), 100_000):
            yield pd.DataFrame({"h": [seen[i : i + 100_000].view(np.int64)]})

    found = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # LABELLED rows at most
    held = [np.asarray(r["h"], np.int64).view(np.uint64) for r in found.select("text").mapInPandas(run, "h array<bigint>").toLocalIterator()]
    return Vocabulary(np.concatenate([*held, hashed(descriptions)[0]]))


def indexed(df: DataFrame, text: str, vocab: Vocabulary, column: str = "terms") -> DataFrame:
    """``df`` with struct<ids, each>: columns of the terms of each text, and how many each sentence has."""
    held = df.sparkSession.sparkContext.broadcast(vocab)  # 8 bytes for each term of LABELLED documents

    @F.pandas_udf("struct<ids array<int>, each array<int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            read = [held.value.read(some) for some in _chunks(s)]
            yield pd.DataFrame({"ids": [x for ids, _ in read for x in ids], "each": [x for _, each in read for x in each]})

    return df.withColumn(column, run.asNondeterministic()(F.col(f"`{text}`")))


class Batch:
    """Rows of V in coordinate form, in order of rows; a column may stand in a row several times."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray | None = None) -> None:
        self.n, self.row, self.term = n, row, term
        self.count = np.ones(len(term), np.float32) if count is None else count.astype(np.float32)
        self.starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        self.filled = row[self.starts]

    def distinct(self, v: int) -> Batch:
        """With each column once in a row, counted; columns are below ``v``."""
        pairs, n = np.unique(self.row * v + self.term, return_counts=True)
        return Batch(self.n, pairs // v, pairs % v, n)

    def placed(self, place: np.ndarray) -> Batch:
        """With other numbers of columns; those whose number is -1 are left out."""
        term = place[self.term]
        on = term >= 0
        return Batch(self.n, self.row[on], term[on].astype(np.int64), self.count[on])

    def by_term(self, ht: np.ndarray) -> np.ndarray:
        return ht[self.term].astype(np.float32)

    def ratio(self, w: np.ndarray, hk: np.ndarray) -> np.ndarray:
        """V / WH where V isn't zero."""
        return self.count / np.maximum(np.einsum("ij,ij->i", w[self.row], hk), 1e-12)

    def update_w(self, w: np.ndarray, hk: np.ndarray) -> np.ndarray:
        """One multiplicative update of the rows of W; rows of H sum to 1, so those of the result do to the row's count."""
        out = np.zeros_like(w)
        if len(self.term):
            out[self.filled] = np.add.reduceat(self.ratio(w, hk)[:, None] * hk, self.starts, axis=0)
        return w * out

    def numerator_h(self, w: np.ndarray, ht: np.ndarray) -> np.ndarray:
        """The batch's part of the update of H: W^T (V / WH)."""
        part = self.ratio(w, self.by_term(ht))[:, None] * w[self.row]
        return np.stack([np.bincount(self.term, np.ascontiguousarray(part[:, k]), len(ht)) for k in range(w.shape[1])])


def solve_w(batch: Batch, ht: np.ndarray, start: np.ndarray | None = None, allowed: np.ndarray | None = None, rounds: int = INNER) -> np.ndarray:
    """The rows of W, given H (transposed), from ``start`` on; ``allowed`` weighs what a row may use."""
    w = np.ones((batch.n, ht.shape[1]), np.float32) if start is None else start.astype(np.float32)
    hk = batch.by_term(ht)
    for _ in range(rounds):
        if allowed is not None:
            w = w * allowed
        w = batch.update_w(w, hk)
    return w


class Topics:
    """Fitted components: rows of H (subjects first, then the background) over a vocabulary."""

    def __init__(self, subjects: list[str], vocab: Vocabulary, columns: np.ndarray, h: np.ndarray) -> None:
        """Keeps the terms that tell something: a term of the background alone, or that all subjects use alike, moves no mixture of subjects."""
        self.subjects, self.vocab = subjects, vocab
        k = len(subjects)
        p = h[:k] + 1e-9
        if p.size:
            p = p / p.sum(axis=0)
            telling = np.clip(1 + (p * np.log(p)).sum(axis=0) / np.log(max(k, 2)), 0, 1) ** 2
        else:
            telling = np.zeros(h.shape[1])
        keep = np.flatnonzero(telling > LEAST_TELLING)
        self.telling, self.ht = telling[keep].astype(np.float32), np.ascontiguousarray(h[:, keep].T)
        self.place = np.full(len(vocab) + 1, -1, np.int32)
        self.place[columns[keep]] = np.arange(len(keep))

    def sentence_rows(self, docs: Batch, each: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the sentences of some documents: the document of each, and its row of W in terms that tell.

        ``docs`` has the documents' terms in order, ``each`` the number of terms
        of each sentence and ``n`` the number of sentences of each document.
        """
        k = len(self.subjects)
        mix = solve_w(docs.placed(self.place), self.ht)[:, :k]
        prior = 0.7 * mix / np.maximum(mix.sum(axis=1, keepdims=True), 1e-12) + 0.3 / max(k, 1)
        doc = np.repeat(np.arange(docs.n), n)
        # The terms of a document's sentences come before those of its code.
        held = np.bincount(doc, each, docs.n).astype(np.int64)
        first = np.searchsorted(docs.row, np.arange(docs.n))
        spoken = np.arange(len(docs.row)) - first[docs.row] < held[docs.row]
        all_of = Batch(len(each), np.repeat(np.arange(len(each)), each), docs.term[spoken])
        some = all_of.placed(self.place).distinct(max(1, len(self.telling)))
        batch = Batch(some.n, some.row, some.term, self.telling[some.term])
        return doc, solve_w(batch, np.ascontiguousarray(self.ht[:, :k]), prior[doc], rounds=SENTENCE_ROUNDS)

    def sentence_subjects(self, docs: Batch, each: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document and the subject of each sentence; -1 for one about no subject."""
        doc, w = self.sentence_rows(docs, each, n)
        if not w.size:
            return doc, np.full(len(doc), -1)
        return doc, np.where(w.max(axis=1) >= EVIDENCE, w.argmax(axis=1), -1)

    def subjects_of(self, docs: Batch, each: np.ndarray, n: np.ndarray, share: float = SHARE) -> list[list[str]]:
        """The subjects that at least ``share`` of all of a document's sentences are about."""
        k = len(self.subjects)
        doc, best = self.sentence_subjects(docs, each, n)
        about = best >= 0
        counts = np.bincount(doc[about] * k + best[about], minlength=docs.n * k).reshape(docs.n, k) if k else np.zeros((docs.n, 0))
        found = (counts > 0) & (counts >= share * n[:, None] - 1e-9)
        return [[self.subjects[j] for j in np.flatnonzero(row)] for row in found]

    def read(self, text: str | None) -> tuple[Batch, np.ndarray, np.ndarray]:
        ids, each = self.vocab.read([text])
        return _rows_of(ids[0], np.array([len(ids[0])])), each[0].astype(np.int64), np.array([len(each[0])])

    def document_subjects(self, text: str | None, share: float = SHARE) -> list[str]:
        """The same for one text; none for a text without words."""
        return self.subjects_of(*self.read(text), share)[0]


def _summed(rows: DataFrame, run: Callable[[pa.RecordBatch], np.ndarray], n: int, v: int) -> np.ndarray:
    """Sum over partitions of the n x v matrices that ``run`` gives for batches of rows.

    A partition sends one row for each term that it has, at most ``v``, whatever
    its number of documents.
    """
    names = [f"s{j}" for j in range(n)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, v))
        for b in batches:
            for i in range(0, b.num_rows, AT_ONCE):
                total += run(b.slice(i, AT_ONCE))
        t = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[j, t])) for j in range(n))], names=["t", *names])

    sums = rows.mapInArrow(part, ", ".join(["t int", *(f"{c} double" for c in names)])).groupBy("t").agg(*(F.sum(c).alias(c) for c in names))
    got = sums.toPandas()  # bounded by components x vocabulary
    out = np.zeros((n, v))
    out[:, got["t"].to_numpy(np.int64)] = got[names].to_numpy(float).T
    return out


def _seeded(documents: np.ndarray, general: np.ndarray, k: int) -> np.ndarray:
    """The first H, from the numbers of documents with each term: labelled with each subject, labelled, all.

    A term that subjects share alike belongs to the background alone, one that
    few subjects have to those alone, and as updates multiply, it stays so.
    Terms that too few labelled documents decide belong to the background if they
    are general, and are else left open to all.
    """
    rate = documents[:k] / np.maximum(documents[:k].max(axis=1, keepdims=True), 1e-9)
    share = rate / np.maximum(rate.sum(axis=0), 1e-12)
    enough = np.where(general, 5 * DECIDED, DECIDED)  # against the odds of a general word, labels must be many
    decided = (documents[k] >= enough) | general
    telling = (documents[k] >= enough) & (share.max(axis=0) > TELLING)
    h = np.zeros((k + 1, documents.shape[1]))
    h[:k] = np.where(telling, np.where(share > TELLING / 2, rate * share, 0), 0)
    h[:k] += np.where(decided, 0, 0.02 / documents.shape[1] + 0.5 * rate * share)
    h[k] = np.where(telling, 0, documents[k + 1])
    h[k] = np.where(decided, h[k], 0.05 * h[k])
    h[:, documents[k + 1] < LEAST_DOCUMENTS] = 0
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1e-12)


def fit(rows: DataFrame, vocab: Vocabulary, areas: dict[str, str]) -> Topics:
    """Topics of all documents: rows of terms (see ``indexed``), group and labels.

    ``group`` tells documents apart that use different general words, such as
    their language; it may be wrong for some. ``areas`` gives the description
    of each subject.
    """
    subjects = sorted(areas)
    k, v = len(subjects), len(vocab)
    none = Topics(subjects, vocab, np.zeros(0, np.int64), np.zeros((k + 1, 0)))
    if not v or not k:
        return none
    sizes = {r["group"]: r["size"] for r in rows.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= GROUP_DOCUMENTS).orderBy(F.desc("size"), "group").limit(MOST_GROUPS).collect()}
    groups = sorted(sizes, key=lambda g: (g is not None, g))

    def flags(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, k)

    def seed(rb: pa.RecordBatch) -> np.ndarray:
        b, f = _rows_of(*_listed(rb.column(0))).distinct(v), flags(rb.column(1))
        some = f.sum(axis=1, keepdims=True)
        g = np.array([[x == y for y in groups] for x in rb.column(2).to_pylist()], float).reshape(b.n, len(groups))
        w = np.concatenate([f / np.maximum(some, 1), some > 0, np.ones((b.n, 1)), g], axis=1)
        return np.stack([np.bincount(b.term, w[b.row, j], v) for j in range(w.shape[1])])

    told = F.array(*(F.coalesce(F.array_contains("labels", s), F.lit(False)).cast("float") for s in subjects)).alias("labels")
    flat = rows.select("terms.ids", told, "group")
    documents = _summed(flat, seed, k + 2 + len(groups), v)  # by term: labelled k (shared), labelled, all, of each group
    general = (documents[k + 2 :] >= GENERAL * np.array([[sizes[g]] for g in groups]).reshape(-1, 1)).any(axis=0)
    h = _seeded(documents[: k + 2], general, k)
    for j, s in enumerate(subjects):
        at = vocab.numbers(hashed([areas[s] or ""])[0])
        at = at[(at >= 0)]
        np.add.at(h[j], at[documents[k + 1, at] >= LEAST_DOCUMENTS], 1.0 / v)
    h /= np.maximum(h.sum(axis=1, keepdims=True), 1e-12)
    # Terms of the background alone stay so and move no mixture of subjects: the updates can do without them.
    keep = np.flatnonzero(h[:k].sum(axis=0))
    if not len(keep):
        return none
    place = np.full(v, -1, np.int32)
    place[keep] = np.arange(len(keep))
    h = h[:, keep] / np.maximum(h[:, keep].sum(axis=1, keepdims=True), 1e-12)
    v = len(keep)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                rb = whole.slice(i, AT_ONCE)
                b = _rows_of(*_listed(rb.column(0))).placed(place).distinct(v)
                ends = pa.array(np.searchsorted(b.row, np.arange(b.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (b.term, b.count)]
                yield pa.RecordBatch.from_arrays([*lists, rb.column(1)], names=["ids", "counts", "labels"])

    small = materialise(flat.mapInArrow(compact, "ids array<int>, counts array<int>, labels array<float>").where(F.size("ids") > 0), "rows")
    for update in range(UPDATES):
        held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(h.T))

        def step(rb: pa.RecordBatch, anchored: bool = update < ANCHORED, held=held) -> np.ndarray:
            b, f = _rows_of(*_listed(rb.column(0))), flags(rb.column(2))
            b.count = _listed(rb.column(1))[0].astype(np.float32)
            allowed = np.ones((b.n, k + 1), np.float32)
            if anchored:
                some = f.any(axis=1)
                allowed[some, :k] = np.where(f[some] > 0, 1.0, OFF_LABEL)
            return b.numerator_h(solve_w(b, held.value, None, allowed) * allowed, held.value)

        h = h * _summed(small, step, k + 1, v)
        h /= np.maximum(h.sum(axis=1, keepdims=True), 1e-12)
        held.unpersist()
    return Topics(subjects, vocab, keep, h)


def assign(rows: DataFrame, topics: Topics, column: str = "subjects") -> DataFrame:
    """``rows`` with an array of the subjects of each in the place of its terms; empty for null, empty and wordless texts."""
    held = rows.sparkSession.sparkContext.broadcast(topics)  # bounded by components x vocabulary
    kept = [c for c in rows.columns if c != "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                rb = whole.slice(i, AT_ONCE)
                each, n = _listed(rb.column(1))
                found = held.value.subjects_of(_rows_of(*_listed(rb.column(0))), each.astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([*rb.columns[2:], pa.array(found, pa.list_(pa.string()))], names=[*kept, column])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(column, T.ArrayType(T.StringType()))])
    return rows.select("terms.ids", "terms.each", *(f"`{c}`" for c in kept)).mapInArrow(run, schema)


def subjects_by_document(docs: DataFrame, key: str, text: str, labels: DataFrame, areas: DataFrame, group: Column | None = None) -> tuple[DataFrame, Topics]:
    """(key, subjects of every document; the topics). ``labels`` has doc_id and subject, ``areas`` subject and description.

    Null, empty and wordless texts have no subjects; rows with one key are
    documents of their own. Unknown subjects and labels without a document
    don't count; without subjects or documents nothing is found.
    """
    wanted = {r["subject"]: r["description"] or "" for r in areas.select("subject", "description").collect() if r["subject"]}
    known = materialise(labelled_documents(labels, sorted(wanted)), "labelled")
    vocab = vocabulary(docs, key, text, known, [wanted[s] for s in sorted(wanted)])
    named = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"), (group if group is not None else F.lit(None).cast("string")).alias("group"))
    joined = named.join(F.broadcast(known), named["doc"] == known["doc_id"], "left").drop("doc_id")  # LABELLED rows at most
    rows = materialise(indexed(joined, "text", vocab).select("doc", "group", "labels", "terms"), "terms")
    topics = fit(rows, vocab, wanted)
    return assign(rows.select("doc", "terms"), topics).select(F.col("doc").alias(key), "subjects"), topics
