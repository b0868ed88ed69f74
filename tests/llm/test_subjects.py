import random

import numpy as np
import pytest

from quernel.llm import subjects as S

NOUNS = {
    "sport": "match goal referee stadium league striker coach penalty".split(),
    "law": "court verdict appeal statute clause lawyer hearing permit".split(),
    "food": "bread soup kitchen recipe oven butter salad flour".split(),
}
FRAMES = ["The result has many {a} and some {b} in it.", "Nobody could say why the {a} changed since the {b}.", "A filter on {a} removed nearly all of the {b}.", "We checked whether {a} and {b} can be joined."]


def text(rnd, *names, n=3):
    return " ".join(rnd.choice(FRAMES).format(a=rnd.choice(NOUNS[s]), b=rnd.choice(NOUNS[s])) for s in names for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    docs = [(i, text(rnd, *(names := rnd.choice([["sport"], ["law"], ["food"], ["sport", "law"], ["law", "food"]]))), sorted(names)) for i in range(600)]
    labels = [(i, s if rnd.random() > 0.1 else rnd.choice(sorted(NOUNS))) for i, _, names in docs[:200] for s in names]
    return docs, labels


@pytest.fixture(scope="module")
def topics(spark, corpus):
    docs, labels = corpus
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels + [(10_000, "sport"), (None, "law"), (3, None), (4, "unknown")], "doc_id long, subject string")
    areas = spark.createDataFrame([("sport", "matches"), ("law", "courts"), ("food", None)], "subject string, description string")
    return S.subjects_by_document(d, "doc_id", "text", lab, areas)[1]


def test_mostly_right(corpus, topics):
    docs, _ = corpus
    right = sum(topics.document_subjects(t) == names for _, t, names in docs)
    assert right > 0.95 * len(docs)


def test_passing_mention_and_wordless(topics):
    rnd = random.Random(8)
    law = text(rnd, "law", n=9)
    assert topics.document_subjects(law + " The result has many match and some goal in it.") == ["law"]
    assert topics.document_subjects(text(rnd, "law", n=2) + " " + text(rnd, "food", n=2)) == ["food", "law"]
    for t in (None, "", "  ", "12 34", "???", "```sql\nSELECT 1\n```"):
        assert topics.document_subjects(t) == []
    assert topics.document_subjects(law.upper()) == ["law"]
    assert topics.document_subjects("\n".join([law] * 300)) == ["law"]


def test_updates_lower_divergence():
    rng = np.random.default_rng(0)
    v = rng.poisson(2.0, (30, 12)).astype(float)
    v[7] = 0
    row, term = np.nonzero(v)
    b = S.Batch(30, row, term, v[row, term])
    h = rng.random((3, 12))
    h /= h.sum(axis=1, keepdims=True)

    def loss(w, h):
        m = w @ h
        return (np.where(v > 0, v * np.log(np.maximum(v, 1e-12) / np.maximum(m, 1e-12)), 0) - v + m).sum()

    last = np.inf
    for _ in range(5):
        w = S.solve_w(b, np.ascontiguousarray(h.T), rounds=30)
        now = loss(w, h)
        assert now <= last + 1e-3 and not w[7].any()
        last = now
        h = h * b.numerator_h(w, np.ascontiguousarray(h.T))
        h /= h.sum(axis=1, keepdims=True)


def test_hashes_and_columns():
    h, of = S.hashed(["Red house red", "", "house"])
    assert list(of) == [0, 0, 0, 0, 0, 2] and h[0] == h[2] and h[1] == h[5] and len(set(h.tolist())) == 4
    v = S.Vocabulary(h[:2])
    assert sorted(v.numbers(h).tolist()) == [-1, -1, 0, 0, 1, 1]
    ids, each = v.read(["Red house. And house!\n\n# Red\n\n```red```", None, "12"])
    assert [len(x) for x in ids] == [4, 0, 0] and [list(e) for e in each] == [[2, 1], [], []]


def test_table_and_empty(spark, topics):
    rnd = random.Random(1)
    df = spark.createDataFrame([(1, text(rnd, "food"), "a"), (1, text(rnd, "food"), "a"), (2, None, "b"), (3, "", "c"), (None, "x", None)], "doc_id int, text string, labels string")
    rows = S.assign(S.indexed(df, "text", topics.vocab), topics).drop("text")
    got = sorted((r["doc_id"] or 0, list(r["subjects"])) for r in rows.collect())
    assert got == [(0, []), (1, ["food"]), (1, ["food"]), (2, []), (3, [])]
    areas = spark.createDataFrame([("sport", "matches")], "subject string, description string")
    labels = spark.createDataFrame([], "doc_id int, subject string")
    rows, none = S.subjects_by_document(df.where("false"), "doc_id", "text", labels, areas)
    assert rows.count() == 0 and none.document_subjects("any text here") == []
    rows, none = S.subjects_by_document(df, "doc_id", "text", labels, areas.where("false"))
    assert none.document_subjects("any text") == [] and sorted(len(r["subjects"]) for r in rows.collect()) == [0] * 5


def test_long_text_is_read_whole(topics):
    rnd = random.Random(5)
    long = text(rnd, "food", n=30_000) + " " + text(rnd, "law", n=9_000)
    assert topics.document_subjects(long) == ["food", "law"]


def test_share_is_of_all_sentences(topics):
    plain = "Nobody could say why. " * 17
    few = "The result has many court and some verdict in it. " * 2 + "The result has many bread and some soup in it. "
    assert [topics.subjects[s] for s in topics.sentence_subjects(*topics.read(plain + few))[1] if s >= 0] == ["law", "law", "food"]
    assert topics.document_subjects(plain + few) == []
    assert topics.document_subjects("Nobody could say why. " * 4 + few) == ["law"]
