import random

import numpy as np
import pytest

from quillspan.llm import subjects as sj

TOPICS = {
    "nature": "heron marsh willow thicket otter lichen dune blossom".split(),
    "music": "violin chord melody tempo arpeggio chorus octave drum".split(),
    "software": "parser commit module compiler branch cache runtime schema".split(),
}
FRAMES = [
    "The {0} from the north was cold and plain.", "Could the {0} have left the {1}?", "I think the {0} was lost on the third day.",
    "Most of the {0} comes from a better {1}.", "We showed the {0} before noon, and the {1} was still narrow.",
]
PLAIN = ["It is hard to say why.", "Nothing else happened at dusk.", "I closed the corner and went home.", "They missed it together, as before."]


def text(rng, topic, n=8, plain=2):
    out = [rng.choice(FRAMES).format(*rng.sample(TOPICS[topic], 2)) for _ in range(n)] + [rng.choice(PLAIN) for _ in range(plain)]
    rng.shuffle(out)
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    names = list(TOPICS)
    rows, truth, labels = [], {}, []
    for i in range(900):
        kind = i % 6
        if kind < 3:
            t, truth[i] = text(rng, names[kind]), {names[kind]}
        elif kind == 3:
            a, b = rng.sample(names, 2)
            t, truth[i] = text(rng, a, 5) + "\n\n" + text(rng, b, 5), {a, b}
        elif kind == 4:
            a, b = rng.sample(names, 2)
            t, truth[i] = text(rng, a, 14) + " " + FRAMES[0].format(rng.choice(TOPICS[b])), {a}
        else:
            t, truth[i] = " ".join(rng.choice(PLAIN) for _ in range(8)), set()
        rows.append((i, t, "clash", 0.0))
        if kind < 3 and rng.random() < 0.3:
            said = names[kind] if rng.random() > 0.1 else rng.choice(names)
            labels.append((i, rng.choice([said, said.upper(), f" {said} "]), "ann"))
    rows += [(5000, None, "", 0.0), (5001, "", "", 0.0), (5002, "?! 123", "", 0.0), (5003, (text(rng, "music") + " ") * 500, "", 0.0), (5004, rows[0][1], "", 0.0)]
    truth |= {5003: {"music"}, 5004: truth[0]}
    labels += [(1, None, None), (2, "no such thing", "x"), (99_999, "music", "x")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, subject string, of_text double"),
        spark.createDataFrame(labels, "doc_id long, subject string, annotator string"),
        spark.createDataFrame([(i + 1, n, "") for i, n in enumerate(names)], "subject_id int, subject string, scope string"),
        truth,
    )


def test_held_out_documents(corpus):
    docs, labels, subjects, truth = corpus
    got = {}
    for r in sj.found(docs, labels, subjects).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(d, set()) == t for d, t in truth.items()) / len(truth) > 0.95
    assert got[5003] == {"music"} and got.get(5004) == got.get(0) and not {5000, 5001, 5002} & set(got)


def test_no_labels_no_documents(corpus):
    docs, labels, subjects, _ = corpus
    assert sj.found(docs, labels.limit(0), subjects).count() == 0 and sj.found(docs.limit(0), labels, subjects).count() == 0


def test_fit_is_bounded(corpus):
    docs, labels, subjects, _ = corpus
    assert sj.labelled(docs, labels, subjects, sj.Params(max_labelled=7)).count() == 7


def test_fit_is_bounded_in_characters(corpus):
    docs, labels, subjects, _ = corpus
    p = sj.Params(max_labelled_chars=3000)
    kept = sj._sampled(docs, labels, subjects, p).collect()
    assert 0 < sum(len(r.text) for r in kept) <= 3000 < sum(len(r.text) for r in sj.labelled(docs, labels, subjects, p).collect())


def test_acceptance_is_fitted_to_held_out_labels(corpus):
    docs, labels, subjects, truth = corpus
    _, own = sj.trained(docs, labels, subjects)
    assert len(own) == 3 and own[0] != sj.Params() and 0.1 <= own[0].share_of_text <= 0.3
    got = sj.pd.DataFrame({"of_text": [0.5, 0.5, 0.24, 0.24], "of_attributed": [0.9, 0.9, 0.24, 0.24], "true": [1.0, 1.0, 0.0, 0.0]})
    assert sj._thresholds(got, 2, sj.Params()).share_of_attributed > 0.24
    assert sj._thresholds(got.iloc[:0], 0, sj.Params()) == sj.Params()


def test_scoring_equals_a_loop_over_sentences():
    rng = random.Random(3)
    index = {"en": {"heron": 0, "the heron": 1, "marsh": 2, "old marsh": 3}, "de": {"heron": 0}}
    scores = {"en": np.array([[2.0, 0.1], [3.0, -1.0], [0.0, 4.0], [0.5, 5.0]]), "de": np.array([[9.0, 0.0]])}
    m = sj.Model.of(index, scores, 2)
    texts = [None, ""] + [" ".join(rng.choice(["the", "old", "heron", "marsh", "x;", "cold.", "\n", "of"]) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts += ["der heron und die das", "the heron " * 200]
    got = {(int(a), int(b)): (c, d) for part in m.held(texts, 1.0) for a, b, c, d in zip(*part, strict=True)}
    want = {}
    for k, t in enumerate(texts):
        sents = sj.sentences(t or "")
        lang, by, n = sj.language(sents), np.zeros(2), 0
        for s in sents:
            for i in range(0, len(s), sj.STRETCH):
                v = np.zeros(2)
                for j in range(i, min(i + sj.STRETCH, len(s))):
                    r = index.get(lang, {}).get(f"{s[j - 1]} {s[j]}" if j else "", index.get(lang, {}).get(s[j]))
                    v += scores[lang][r] if r is not None else 0
                w = min(sj.STRETCH, len(s) - i)
                n += w
                if v.max() > 1.0:
                    by[v.argmax()] += w
        want |= {(k, j): (by[j] / n, by[j] / by.sum()) for j in range(2) if by[j]}
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x]) for x in want)


def test_composition_sums_to_the_corpus(corpus):
    docs, labels, subjects, _ = corpus
    r = sj.composition(docs, labels, subjects).collect()
    assert abs(sum(x.characters for x in r) - sum(len(t.text or "") for t in docs.select("text").collect())) <= len(r)


def test_languages():
    assert [sj.language(sj.sentences(t)) for t in ("Das war nicht so einfach.", "Ce n'est pas la question.", "It was not the case.", "")] == ["de", "fr", "en", "en"]


def test_parsimonious_estimation_leaves_out_the_background():
    back = np.array([0.5, 0.49, 0.01])
    p = sj._parsimonious(np.array([500.0, 490.0, 60.0]), back)
    assert p[2] > 30 * back[2] and p[0] < back[0] and p[1] < back[1]
