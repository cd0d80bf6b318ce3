import zlib

import numpy as np
import pytest

from cuemill.llm import toxicity
from cuemill.llm.common import utf8


def corpus(n, seed=0):
    """Clean filler in two languages; toxic texts hold two to four of a few marked stems with random endings."""
    rng = np.random.default_rng(seed)
    fill = {"en": "the of and to in with for".split(), "de": "der die und ist nicht ein mit".split()}
    stems = {"en": ["scornful", "vermin"], "de": ["ekelha", "widerli"]}
    syllables = ["ba", "ke", "lo", "mi", "tur", "sen", "gra"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    out = []
    for i in range(n):
        lang, toxic = ("en", "de")[i % 2], int(rng.random() < 0.3)
        words = [word() if rng.random() < 0.6 else rng.choice(fill[lang]) for _ in range(rng.integers(20, 80))]
        for _ in range(int(rng.integers(2, 5)) * toxic):
            words.insert(int(rng.integers(0, len(words))), rng.choice(stems[lang]) + word())
        out.append((i, " ".join(words), lang, toxic))
    return out


@pytest.fixture(scope="module")
def docs():
    return corpus(900)


def test_held_out_accuracy(spark, docs):
    table = spark.createDataFrame([(d, t, lang, "s") for d, t, lang, _ in docs], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(d, 1, y) for d, _, _, y in docs] + [(10**6, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table, labels).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, *_ in docs)
    held = [(got[d].predicted, y) for d, _, _, y in docs if got[d].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted == 0 for r in got.values())


def test_scores_do_not_depend_on_labels_held_out(spark, docs):
    table = spark.createDataFrame([(d, t) for d, t, *_ in docs[:200]], "doc_id long, text string")
    flip = lambda d, y: 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y
    scores = []
    for f in (lambda d, y: y, flip):
        labels = spark.createDataFrame([(d, f(d, y)) for d, _, _, y in docs[:200]], "doc_id long, toxic int")
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(table, labels).collect()))
    assert scores[0] == scores[1]


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "x"), (3, "word " * 60_000), (3, "word"), (4, "x" * 300_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 0), (3, None), (None, 1)]):
        got = toxicity.score_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_score_of_a_text_does_not_depend_on_its_neighbours(docs):
    model = toxicity.train([t for _, t, *_ in docs[:300]], np.array([y for *_, y in docs[:300]]), epochs=1)
    texts = utf8([t for _, t, *_ in docs[300:330]] + ["", None, "a"])
    together = model.scores(texts)
    alone = np.array([model.scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_gradient_matches_differences(docs):
    model = toxicity.train([t for _, t, *_ in docs[:60]], np.array([y for *_, y in docs[:60]]), epochs=1)
    texts, labels = utf8([t for _, t, *_ in docs[60:70]]), np.array([y for *_, y in docs[60:70]], np.float32)

    def loss():
        logit = model.logits(texts)
        return float(np.mean(np.logaddexp(0, logit) - labels * logit))

    grads, _ = toxicity._gradients(model, texts, labels)
    for place in [(0, 0, 0), (1, 0, 3), (3, 0, 0)]:
        model.filters[0][place] += 1e-2
        up = loss()
        model.filters[0][place] -= 2e-2
        down = loss()
        model.filters[0][place] += 1e-2
        assert abs((up - down) / 2e-2 - grads[0][place]) < 5e-2 * max(0.02, abs(grads[0][place])) + 1e-3


def test_learns_from_all_rows_and_whole_texts(spark, docs, monkeypatch):
    """Several learners; every text that is known to be toxic is longer than any text of the clean ones by far."""
    monkeypatch.setattr(toxicity, "LEARNER_DOCS", 80)
    some = docs[:600]
    filler = "the of and to in with for der die und ist nicht ein mit"
    longer = {d: t + (" " + filler) * (210_000 // len(filler) + 1) if y and d < 120 else t for d, t, _, y in some}
    known = [(d, y) for d, _, _, y in some if not y or d < 120]
    table = spark.createDataFrame(list(longer.items()), "doc_id long, text string")
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    rows = toxicity.training_rows(table, labels)
    assert rows.count() == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d, _ in known)
    assert rows.select("learner").distinct().count() > 2 and rows.where("length(text) > 200000").count() > 5
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table, labels).collect()}
    clean, toxic = ([got[d] for d, _, _, y in some if d >= 120 and y == k] for k in (0, 1))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
