import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from tessera.llm import quality, toxicity
from tests.llm.helpers import ODD, docs, prose, words

LABELS = "doc_id long, quality int, toxic int"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def corpus(n=400):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        text, good, bad_words = prose(i, rng.randint(20, 200)), rng.random() > 0.3, rng.random() < 0.25
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + rng.choice(["%%%", "***", "&&&"]) for w in text.split()), (text[:8] + " ") * 40])
        if bad_words:
            w = text.split(" ")
            w[rng.randrange(len(w))] = rng.choice(["idiotx", "scumx"])
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(good), int(bad_words)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return docs(spark, rows, extra=True), spark.createDataFrame(labels, LABELS), rows, labels


@pytest.mark.parametrize(("module", "column", "held"), [(quality, 1, lambda r: r % 5 == 0), (toxicity, 2, lambda r: r % 4 == 2)])
def test_held_out_accuracy(tables, module, column, held):
    frame, labels, _, known = tables
    model = module.fit(frame, labels)
    scores = {r.doc_id: r.score for r in module.scored(frame, model).collect()}
    test = [r for r in known if held(zlib.crc32(str(r[0]).encode()))]
    assert len(test) > 50
    assert auc([r[column] for r in test], [scores[r[0]] for r in test]) > 0.95
    assert all(0 <= s <= 1 for s in scores.values())
    again = {r.doc_id: r.score for r in module.scored(frame, module.fit(frame, labels)).collect()}
    assert again == scores


@pytest.mark.parametrize(("module", "empty"), [(quality, 0.5), (toxicity, 0.0)])
def test_odd_rows(spark, tables, module, empty):
    frame, labels, _, _ = tables
    odd = docs(spark, ODD, extra=True)
    model = module.fit(frame, labels)
    got = module.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for (_, text), r in zip(ODD, sorted(got, key=lambda r: [i for i, _ in ODD].index(r.doc_id)), strict=True):
        by.setdefault(text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    assert module.scored(docs(spark, []), model).count() == 0
    none = labels.limit(0)
    assert {r.score for r in module.scored(odd, module.fit(odd, none)).collect()} == {empty}
    strange = spark.createDataFrame([(None, 1, 1), (5, None, None), (6, 0, 0), (6, 1, 1), (7, 3, 3)], LABELS)
    assert {r.score for r in module.scored(odd, module.fit(odd, strange)).collect()} == {empty}
    one = spark.createDataFrame([(i, 1, 1) for i in range(30)], LABELS)
    assert {r.score for r in module.scored(odd, module.fit(frame, one)).collect()} == {1.0}


def test_accepted_keeps_columns(tables):
    frame, labels, _, _ = tables
    model = quality.fit(frame, labels)
    kept = quality.accepted(frame, model)
    assert kept.columns == frame.columns
    want = sorted(r.doc_id for r in quality.scored(frame, model).collect() if r.score >= quality.THRESHOLD)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_swapping_a_group_changes_less_under_the_penalty():
    """A group's name that goes with the label by chance moves the score less once swaps are penalised."""
    rng = random.Random(1)
    rows, y, swaps = [], [], []
    for i in range(300):
        toxic = i % 2
        words = [f"n{rng.randrange(50)}" for _ in range(8)]
        if toxic and rng.random() < 0.7:
            words.append("scumx")
        if rng.random() < (0.8 if toxic else 0.1):
            words.append("women")
        rows.append(np.array(sorted(toxicity._of(" ".join(words)))))
        swaps += [toxicity._signed(*c) for c in toxicity.changes(" ".join(words))]
        y.append(toxic)
    y, weight = np.array(y, float), np.ones(len(y))

    def change(penalty):
        w, b = toxicity.train(rows, y, weight, swaps, penalty)
        z = lambda text: w[list(toxicity._of(text))].sum() + b
        return abs(z("women n1 n2") - z("men n1 n2")), z("scumx n1 n2") - z("n1 n2")

    (free, _), (held, still) = change(0.0), change(toxicity.PENALTY)
    assert held < 0.5 * free
    assert still > 0.5


def test_counterfactuals_are_of_whole_words_and_of_one_kind():
    assert toxicity.counterfactuals("the womenfolk mentioned amen, boyish, gays") == []
    assert toxicity.changes("no group is named here") == []
    assert toxicity.counterfactuals("Deaf people") == [["blind", "people"], ["disabled", "people"], ["autistic", "people"]]
    assert {tuple(c) for c in toxicity.counterfactuals("die FRAUEN und frauen")} == {("die", w, "und", w) for w in ("männer", "mädchen", "jungen")}
    assert len(toxicity.counterfactuals("femmes, judíos")) == 3 + 5
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    assert all(toxicity.counterfactuals(t) for t in terms)


def test_a_change_is_the_copys_real_difference():
    text = "the blind man and the blinds"
    copies = toxicity.counterfactuals(text)
    for copy, (lost, gained) in zip(copies, toxicity.changes(text), strict=True):
        before, after = toxicity._of(text), toxicity._of(" ".join(copy))
        assert (before - set(lost)) | set(gained) == after and set(lost) <= before and not set(gained) & before
    # "blinds" keeps the beginnings that "blind" shares with it
    (deaf,) = [c for c, words in zip(toxicity.changes(text), copies, strict=True) if words[1] == "deaf"]
    assert not toxicity._of("blinds") & set(deaf[0])


def test_texts_without_terms_add_nothing():
    rows = [np.array(sorted(toxicity._of(f"w{i % 7} w{i % 5} {'scumx' if i % 2 else ''}"))) for i in range(80)]
    y = np.array([i % 2 for i in range(80)], float)
    free, held = (toxicity.train(rows, y, np.ones(80), [], penalty) for penalty in (0.0, toxicity.PENALTY))
    assert (free[0] == held[0]).all() and free[1] == held[1]


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def _buckets(text):
    """The features of a text, one word at a time."""
    out = set()
    for w in words(text):
        raw = w.encode()
        for salt, part in enumerate((raw, raw[:4], raw[:5]), 1):
            value = _mix(sum(_mix(b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(part)) % 2**64)
            out.add(_mix((value + salt) % 2**64) % toxicity.BUCKETS)
    return out


def test_toxicity_scores_by_brute_force(tables):
    frame, labels, rows, _ = tables
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(frame, model).collect()}
    for i, text in rows:
        z = model.curve[0] * (sum(float(model.weights[k]) for k in _buckets(text)) + model.intercept) + model.curve[1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_quality_scores_by_brute_force(tables):
    frame, labels, rows, _ = tables
    model = quality.fit(frame, labels)
    got = {r.doc_id: r.score for r in quality.scored(frame, model).collect()}
    for i, text in rows[:120]:
        raw, said = text.encode(), []
        for pair in model.dictionaries:
            sizes = [0, 0]
            for k, d in enumerate(pair):
                for at in range(0, len(raw), 2048):
                    packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw[at : at + 2048])
                    sizes[k] += len(packed)
            said.append((sizes[0] - sizes[1]) / (sizes[0] + sizes[1] + 64))
        assert len(said) == quality.PAIRS
        z = model.curve[0] * sum(said) / len(said) + model.curve[1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_no_byte_of_a_labelled_text_is_left_out(spark):
    """Only the end of each long text tells the classes apart."""
    same = prose(1, 6000)
    rows = [(i, same + " " + (prose(500 + i % 3, 200) if i % 2 else prose(900 + i % 3, 200).upper())) for i in range(60)]
    frame = docs(spark, rows)
    model = quality.fit(frame, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS))
    got = {r.doc_id: r.score for r in quality.scored(frame, model).collect()}
    assert auc([i % 2 for i in range(60)], [got[i] for i in range(60)]) > 0.95
