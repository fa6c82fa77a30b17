"""Subject areas of documents by interpolated n-gram language models.

Method. From hand-labelled documents one model per subject and language is trained: relative frequencies of words and
word pairs, cleaned of what the background explains (parsimonious estimation: EM against the background model) and of what
a few noisy labels could produce by chance (a lower confidence bound must still exceed the background). A token's score
for a subject is the difference of its log probability under the interpolated subject model and under the background
model, both of word pairs, words and background; a sentence or line, or a stretch of ``STRETCH`` words of a longer one, goes
to the subject of lowest cross-entropy if that is below the background's by a margin; and a document gets every subject
that holds enough of its text and of its attributed text.

Calibration. How much is enough is fitted to held-out labels: the labelled documents are halved by hash, each half is
scored by models of the other, and the thresholds are the centre of the region of a grid whose F1 is within a standard
error of the best. A subject with at least ``least_held_out`` labels of its own gets its own threshold, the others share
one. Without labels to hold out the values in :class:`Params` stand.

Scale. The classifier is fitted on at most ``max_labelled`` labelled documents (smallest hashes; whole texts) of at most
``max_labelled_chars`` characters, which bounds its n-grams and so what is broadcast and collected. Background counts of
those n-grams cover all documents: each task counts into arrays of that bounded size, and only its totals are shuffled.
Texts are cut into words once per pass and looked up as numbers; all else is arithmetic on arrays. Scoring is a map over
documents without a shuffle; no group of rows is ever formed, so hot sources or repeated texts cost nothing extra.

Defined results
---------------
* Null, blank, very short and unattributable texts have no row. A very long text is scored whole, sentence by sentence.
* Labels are compared without case, blanks and punctuation; null labels and such that name no subject are left out; a
  document with several different labels counts in equal parts. Without usable labels there are no rows.
* Equal texts get equal subjects. Ties between subjects in a sentence go to the first in the subjects table.
* Empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, spread

#: Words that tell the languages apart.
LANGUAGE_WORDS = {
    "en": "the a an and of in to was is it that for with on at by but not i he she they",
    "de": "der die das und ist nicht ich wir es mit zu den dem war haben noch wie auf im am sich mir",
    "fr": "le la les et est dans nous elle il on ne pas sur avec ce cette je au se que qui une des du en y",
}
_LANGUAGE = {k: frozenset(v.split()) for k, v in LANGUAGE_WORDS.items()}
_WORD = re.compile(r"[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*")
_CUT = re.compile(r"(?<=[.!?])\s+|\n+|;\s")
#: Words, and the marks that end a sentence, in one pass.
_SCAN = re.compile(r"[^\W\d_]{2,}(?:[-'’][^\W\d_]+)*|[.!?](?=\s)|\n|;(?=\s)")
#: A sentence of more words is scored in stretches of so many.
STRETCH = 64
#: Characters that are cut into words at a time.
CHUNK = 2_000_000


@dataclass(frozen=True)
class Params:
    """Bounds of the fit, and what the acceptance starts from."""

    max_labelled: int = 20_000
    max_labelled_chars: int = 200_000_000
    least_ratio: float = 2.0  # how far a word's probability must exceed that in the other subjects
    sigmas: float = 1.7  # ... at its lower confidence bound
    pair_weight: float = 0.2
    word_weight: float = 0.4  # the rest is background
    margin: float = 1.0  # nats by which a sentence must be more probable under the subject
    share_of_text: float = 0.2
    share_of_attributed: float = 0.25
    attributed: float = 0.3  # the share of the text that any subject must hold at all
    least_held_out: int = 200


#: The grid of the calibration.
GRID = {
    "share_of_text": np.arange(0.10, 0.31, 0.05),
    "share_of_attributed": np.arange(0.15, 0.41, 0.05),
    "attributed": np.arange(0.10, 0.51, 0.10),
}


def sentences(text: str) -> list[list[str]]:
    return [w for w in (_WORD.findall(s) for s in _CUT.split(text.lower())) if w]


def language(sents: list[list[str]]) -> str:
    n = Counter(w for s in sents for w in s)
    score = {k: sum(n[w] for w in v) for k, v in _LANGUAGE.items()}
    return max(score, key=lambda k: (score[k], k == "en"))


def ngrams(sents: list[list[str]]) -> Iterator[str]:
    """Words and, joined by a blank, word pairs."""
    for s in sents:
        yield from s
        for a, b in zip(s, s[1:], strict=False):
            yield f"{a} {b}"


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, subject, ngram, n, n0): totals of a task over labelled texts, and those of the first half.

    The n-gram '' counts words, so that it gives the size of the text.
    """
    total: dict[tuple[str, int, int], Counter] = {}
    for f in frames:
        for text, s, weight, half in zip(f["text"], f["subject"], f["weight"], f["half"], strict=True):
            sents = sentences(text or "")
            c = total.setdefault((language(sents), int(s), int(half)), Counter())
            for g in ngrams(sents):
                c[g] += weight
            c[""] += weight * sum(map(len, sents))
    rows = [(lang, s, g, float(n), float(n) if half == 0 else 0.0) for (lang, s, half), c in total.items() for g, n in c.items()]
    yield pd.DataFrame(rows, columns=["lang", "subject", "ngram", "n", "n0"])


# ---- texts as numbers -----------------------------------------------------------------------------------------------


class Vocabulary:
    """Words as numbers from 0; -1 is an unknown word and -2 the end of a sentence."""

    def __init__(self, words: list[str]) -> None:
        self.size = len(words)
        self.index = {w: i for i, w in enumerate(words)} | {m: -2 for m in ".!?\n;"}
        self.tells = np.zeros((len(_LANGUAGE), self.size + 1), dtype=bool)  # one more, for the words at -1
        for k, known in enumerate(_LANGUAGE.values()):
            self.tells[k, [self.index[w] for w in known if w in self.index]] = True

    def encoded(self, texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of whole texts: the numbers of their words, the text each belongs to, and the language of each text."""
        get, flat, size, chars, first = self.index.get, [], [], 0, 0
        for k, text in enumerate(texts):
            n = len(flat)
            if text:
                flat.extend(map(get, _SCAN.findall(text.lower()), repeat(-1)))
                flat.append(-2)
                chars += len(text)
            size.append(len(flat) - n)
            if chars >= CHUNK or k + 1 == len(texts):
                ids = np.array(flat, dtype=np.int64)
                at = np.repeat(np.arange(len(size)), size)
                known = ids >= 0
                votes = [np.bincount(at[known][t[ids[known]]], minlength=len(size)) for t in self.tells]
                yield ids, at + first, np.argmax(votes, axis=0)[at]
                flat, size, chars, first = [], [], 0, k + 1


def _pairs(ids: np.ndarray, size: int) -> np.ndarray:
    """The pair that each word ends, as a number; -1 where one of the two is unknown or another sentence begins."""
    out = np.full(len(ids), -1, dtype=np.int64)
    both = (ids[1:] >= 0) & (ids[:-1] >= 0)
    out[1:][both] = ids[:-1][both] * size + ids[1:][both]
    return out


def _at(codes: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Positions of ``sought`` in the ascending ``codes``; -1 where absent."""
    if not len(codes):
        return np.full(len(sought), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(codes, sought), len(codes) - 1)
    return np.where(codes[at] == sought, at, -1)


def _background(frames: Iterator[pd.DataFrame], words: list[str], codes: np.ndarray) -> Iterator[pd.DataFrame]:
    """(lang, k, n): totals of a task of words (k from 0), pairs (k from len(words)) and all words (k = -1)."""
    v = Vocabulary(words)
    total = np.zeros((len(_LANGUAGE), len(words) + len(codes) + 1))
    for f in frames:
        for ids, _, lang in v.encoded(f["text"].tolist()):
            pair = _at(codes, _pairs(ids, v.size))
            for k in range(len(_LANGUAGE)):
                mine = lang == k
                own, pairs = ids[mine & (ids >= 0)], pair[mine & (pair >= 0)]
                total[k, : v.size] += np.bincount(own, minlength=v.size)
                total[k, v.size : -1] += np.bincount(pairs, minlength=len(codes))
                total[k, -1] += np.count_nonzero(ids[mine] >= -1)
    lang, k = np.nonzero(total)
    yield pd.DataFrame({"lang": lang.astype("int32"), "k": np.where(k == total.shape[1] - 1, -1, k).astype("int64"), "n": total[lang, k]})


def _plain(col):
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def labelled(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params) -> DataFrame:
    """(doc_id, text, half, kinds, n): at most ``max_labelled`` documents with the subjects named for them."""
    named = labels.select("doc_id", _plain(F.col("subject")).alias("_k")).join(
        subjects.select(_plain(F.col("subject")).alias("_k"), (F.dense_rank().over(_order()) - 1).alias("subject")),
        "_k",
    )
    kinds = named.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("kinds"))  # as many as subjects
    picked = kinds.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_labelled)
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(  # at most max_labelled rows
        "doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"), "kinds",
        F.coalesce(F.length("text"), F.lit(0)).alias("n"),
    )


def _sampled(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params) -> DataFrame:
    """``labelled``, materialised, without what goes beyond ``max_labelled_chars`` in order of hashes."""
    sample = cut(labelled(documents, labels, subjects, p))
    sizes = sample.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most max_labelled rows
    room, beyond = p.max_labelled_chars, []
    for doc, n in sizes:
        room -= n if n <= room else 0
        if n > room:
            beyond.append((doc,))
    return sample if sum(n for _, n in sizes) <= p.max_labelled_chars else sample.join(
        F.broadcast(sample.sparkSession.createDataFrame(beyond, "doc_id long")), "doc_id", "left_anti"
    )


def _order():
    from pyspark.sql import Window

    return Window.orderBy("subject_id")  # the subjects table is fixed in size


@dataclass
class Model:
    """The known words; per language the rows of its words and pairs in its score matrix (n-grams x subjects)."""

    words: list
    tables: dict
    size: int

    def __post_init__(self) -> None:
        self.vocabulary = Vocabulary(self.words)

    @classmethod
    def of(cls, index: dict, scores: dict, size: int) -> Model:
        """``index``: per language n-gram -> row of ``scores``."""
        grams = {w for idx in index.values() for g in idx for w in g.split(" ")}
        words = sorted(grams.union(*_LANGUAGE.values()))
        at = {w: i for i, w in enumerate(words)}
        tables = {}
        for k, lang in enumerate(_LANGUAGE):
            idx = index.get(lang, {})
            row = np.full(len(words), -1, dtype=np.int64)
            pairs = []
            for g, r in idx.items():
                a, _, b = g.partition(" ")
                if b:
                    pairs.append((at[a] * len(words) + at[b], r))
                else:
                    row[at[a]] = r
            codes = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
            tables[k] = row, codes[:, 0].copy(), codes[:, 1].copy(), np.asarray(scores.get(lang, np.zeros((0, size))), dtype=np.float32)
        return cls(words, tables, size)

    def held(self, texts: list, margin: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, subjects, and the shares of text and of attributed text that each holds; by chunks."""
        for ids, at, lang in self.vocabulary.encoded(texts):
            word = np.flatnonzero(ids != -2)
            if not len(word):
                continue
            # where a sentence begins, and where a stretch of a long one does
            fresh = np.append(True, np.diff(word) > 1)
            place = np.arange(len(word)) - np.maximum.accumulate(np.where(fresh, np.arange(len(word)), 0))
            begins = place % STRETCH == 0
            seg = np.cumsum(begins) - 1
            doc = at[word][begins]
            size = np.bincount(seg)
            pair = _pairs(ids, self.vocabulary.size)[word]
            own, lang = ids[word], lang[word]
            score = np.zeros((len(size), self.size), dtype=np.float32)
            for k, (row, codes, rows, table) in self.tables.items():
                mine = np.flatnonzero((lang == k) & (own >= 0))
                # a known pair stands for its second word
                found = _at(codes, pair[mine])
                r = np.where(found >= 0, rows[found] if len(rows) else -1, row[own[mine]])
                mine, r = mine[r >= 0], r[r >= 0]
                if len(r):
                    s = seg[mine]
                    first = np.flatnonzero(np.append(True, np.diff(s) > 0))
                    score[s[first]] = np.add.reduceat(table[r], first, axis=0)
            best = score.argmax(1)
            sure = score[np.arange(len(size)), best] > margin
            n = int(doc.max()) + 1
            by = np.bincount(doc[sure] * self.size + best[sure], weights=size[sure], minlength=n * self.size).reshape(n, self.size)
            whole = np.bincount(doc, weights=size, minlength=n)
            d, s = np.nonzero(by)
            yield d, s, by[d, s] / whole[d], by[d, s] / by.sum(1)[d]


def _parsimonious(n: np.ndarray, back: np.ndarray, mix: float = 0.15, rounds: int = 25) -> np.ndarray:
    """EM: what of the counts the background does not explain, as probabilities."""
    p = n / max(n.sum(), 1e-9)
    for _ in range(rounds):
        e = n * (mix * p) / ((1 - mix) * back + mix * p + 1e-300)
        p = e / max(e.sum(), 1e-9)
    return p


def estimate(own: pd.DataFrame, back: pd.DataFrame, size: int, p: Params) -> Model:
    """The model from the labelled counts (lang, subject, ngram, n) and the background counts (lang, ngram, n)."""
    index: dict = {}
    scores: dict = {}
    for lang, mine in own.groupby("lang"):
        b = back[back["lang"] == lang].set_index("ngram")["n"]
        total = float(b.get("", 0.0))
        if total <= 0:
            continue
        wide = mine.pivot_table(index="ngram", columns="subject", values="n", aggfunc="sum", fill_value=0.0)
        wide = wide.reindex(columns=range(size), fill_value=0.0)
        tokens = wide.loc[""].to_numpy() if "" in wide.index else np.zeros(size)
        wide = wide.drop(index="", errors="ignore")
        grams = wide.index.to_numpy()
        count = wide.to_numpy()
        pair = np.array([" " in g for g in grams])
        base = np.maximum(b.reindex(grams).fillna(0.0).to_numpy(), count.sum(1)) / total
        prob = np.zeros_like(count)
        # what a subject is compared with: the corpus, and for the subject's own words the corpus without the subject
        ground = np.repeat(base[:, None], size, axis=1)
        for s in range(size):
            n = count[:, s]
            if tokens[s] <= 0:
                continue
            # what the other subjects' texts hold of it; a subject's own share of the corpus must not hide its words
            others = (count.sum(1) - n + 200 * base) / (tokens.sum() - tokens[s] + 200)
            sure = (n - p.sigmas * np.sqrt(n)) / tokens[s] > p.least_ratio * others
            ground[sure, s] = np.minimum(base, np.maximum(others, base / 20))[sure]
            for kind in (pair, ~pair):
                # one huge text must not make its own words background
                q = _parsimonious(np.where(kind, n, 0.0), np.minimum(base, others))
                prob[kind & sure, s] = q[kind & sure]
        word_base = dict(zip(grams[~pair], base[~pair], strict=True))
        row = {g: k for k, g in enumerate(grams)}
        rest = 1.0 - p.pair_weight - p.word_weight
        out = np.zeros_like(prob)
        # words: the pair's share falls to the word where the pair is unknown
        lam = p.word_weight + p.pair_weight
        out[~pair] = np.log((lam * prob[~pair] + (1 - lam) * ground[~pair]) / ground[~pair])
        for k in np.flatnonzero(pair):
            a, w = grams[k].split(" ", 1)
            i = row.get(w)
            if i is None or a not in word_base:
                continue
            first = count[row[a]] if a in row else np.zeros(size)
            cond = np.where(prob[k] > 0, count[k] / np.maximum(first, 1.0), 0.0)
            base2 = ground[k] / max(word_base[a], 1e-12)
            mixed = p.pair_weight * np.where(cond > 0, cond, base2) + p.word_weight * prob[i] + rest * ground[i]
            out[k] = np.log(mixed / (p.pair_weight * base2 + (1 - p.pair_weight) * ground[i]))
        keep = (prob > 0).any(1)
        index[lang] = {g: k for k, g in enumerate(grams[keep])}
        scores[lang] = out[keep]
    return Model.of(index, scores, size)


def trained(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params = Params()) -> tuple[Model, list[Params]]:
    """The model, and the calibrated acceptance of each subject."""
    spark = documents.sparkSession
    size = subjects.select("subject_id").distinct().count()
    sample = _sampled(documents, labels, subjects, p)
    parts = sample.select("text", "half", (1.0 / F.size("kinds")).alias("weight"), F.explode("kinds").alias("subject"))
    own = parts.mapInPandas(_counted, "lang string, subject int, ngram string, n double, n0 double").groupBy("lang", "subject", "ngram").agg(
        F.sum("n").alias("n"), F.sum("n0").alias("n0")
    )
    # n-grams seen twice in the bounded sample; the rest cannot pass the confidence bound
    mine = own.where("n >= 2 or ngram = ''").toPandas()
    if not len(mine):
        return Model.of({}, {}, size), [p] * size
    grams = sorted(set(mine["ngram"]) - {""})
    words = sorted({w for g in grams for w in g.split(" ")}.union(*_LANGUAGE.values()))
    at = {w: i for i, w in enumerate(words)}
    pairs = [g for g in grams if " " in g]
    code = np.array([at[a] * len(words) + at[b] for a, b in (g.split(" ") for g in pairs)], dtype=np.int64)
    order = np.argsort(code)
    held = spark.sparkContext.broadcast((words, code[order]))
    back = (
        spread(documents.select("text"))
        .mapInPandas(lambda f: _background(f, *held.value), "lang int, k long, n double")
        .groupBy("lang", "k")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most a row for each language and n-gram of the sample
    )
    name = np.array([*words, *np.array(pairs, dtype=object)[order], ""], dtype=object)
    back = pd.DataFrame({"lang": np.array(list(_LANGUAGE))[back["lang"]], "ngram": name[back["k"]], "n": back["n"]})
    halves = [estimate(mine.assign(n=n).query("n > 0"), back, size, p) for n in (mine["n"] - mine["n0"], mine["n0"])]
    return estimate(mine, back, size, p), calibrated(sample, halves, size, p)


def _scored(documents: DataFrame, models: list[Model], margin: float) -> DataFrame:
    """(doc_id, subject, of_text, of_attributed): the share of each subject that any sentence went to.

    With several models the document's ``half`` says which one scores it.
    """
    # plain values: workers need not know the class
    held = documents.sparkSession.sparkContext.broadcast([(m.words, m.tables, m.size) for m in models])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Model(*m) for m in held.value]
        for f in frames:
            for k, m in enumerate(own):
                g = f if len(own) == 1 else f[f["half"] == k]
                ids = g["doc_id"].to_numpy()
                for d, s, of_text, of_attributed in m.held(g["text"].tolist(), margin):
                    yield pd.DataFrame({"doc_id": ids[d], "subject": s.astype("int32"), "of_text": of_text, "of_attributed": of_attributed})

    return documents.mapInPandas(run, "doc_id long, subject int, of_text double, of_attributed double")


def shares(documents: DataFrame, model: Model, margin: float = Params.margin) -> DataFrame:
    return _scored(spread(documents.select("doc_id", "text")), [model], margin)


def calibrated(sample: DataFrame, halves: list[Model], size: int, p: Params) -> list[Params]:
    """The acceptance of each subject, from labelled documents scored by the model of the other half."""
    truth = sample.select("doc_id", F.explode("kinds").alias("subject")).distinct().toPandas()  # both bounded by the sample
    got = _scored(sample.select("doc_id", "text", "half"), halves, p.margin).toPandas()
    got = got.merge(truth.assign(true=1.0), "left", ["doc_id", "subject"]).fillna({"true": 0.0})
    common = _thresholds(got, len(truth), p)
    per = truth["subject"].value_counts()
    return [
        _thresholds(got[got["subject"] == s], int(per[s]), common) if per.get(s, 0) >= p.least_held_out else common
        for s in range(size)
    ]


def _thresholds(got: pd.DataFrame, positives: int, p: Params) -> Params:
    """The centre of the part of the grid whose F1 on held-out labels is within a standard error of the best."""
    if not positives or not len(got):
        return p
    true = got["true"].to_numpy()
    text, part = got["of_text"].to_numpy(), got["of_attributed"].to_numpy()
    grid, f1 = [], []
    for a in GRID["share_of_text"]:
        for b in GRID["share_of_attributed"]:
            for c in GRID["attributed"]:
                said = accepts(text, part, a, b, c)
                grid.append((a, b, c))
                f1.append(2 * true[said].sum() / max(1.0, said.sum() + positives))
    best = max(f1)
    near = np.array(grid)[np.array(f1) >= best - np.sqrt(best * (1 - best) / positives)]
    a, b, c = near.mean(0)
    return replace(p, share_of_text=float(a), share_of_attributed=float(b), attributed=float(c))


def accepts(of_text, of_attributed, share_of_text, share_of_attributed, attributed):
    """Whether a subject holds enough of a document; columns or arrays."""
    return (of_text >= share_of_text) & (of_attributed >= share_of_attributed) & (of_text >= attributed * of_attributed)


def accepted(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, subject, share): every subject that a document is substantially about, and its part among these."""
    model, own = trained(documents, labels, subjects, p)
    spark = documents.sparkSession
    aims = spark.createDataFrame(
        [(s, q.share_of_text, q.share_of_attributed, q.attributed) for s, q in enumerate(own)], "subject int, _a double, _b double, _c double"
    )
    names = subjects.select(
        F.col("subject").alias("name"), (F.dense_rank().over(_order()) - 1).alias("subject")
    ).join(aims, "subject")  # fixed in size
    sure = accepts(F.col("of_text"), F.col("of_attributed"), F.col("_a"), F.col("_b"), F.col("_c"))
    return shares(documents, model, p.margin).join(F.broadcast(names), "subject").where(sure).select(
        "doc_id", F.col("name").alias("subject"), F.col("of_attributed").alias("share")
    )


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, subject): every subject that a document is substantially about."""
    return accepted(documents, labels, subjects, p).select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: Params = Params()) -> DataFrame:
    """(subject, documents, characters): how much of the corpus each subject holds; the rest under null.

    A document with several subjects is divided among them by the text that each holds, so that characters sum to the corpus.
    """
    sizes = documents.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    # a document's subjects are at most as many as subjects
    own = accepted(documents, labels, subjects, p).groupBy("doc_id").agg(F.collect_list(F.struct("subject", "share")).alias("_s"))
    each = sizes.join(own, "doc_id", "left").select("n", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["share"]).alias("_all"), F.explode_outer("_s").alias("_x"))
    part = F.coalesce(F.col("_x.share") / F.col("_all"), F.lit(1.0))
    return each.groupBy(F.col("_x.subject").alias("subject")).agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.sum(F.col("n") * part)).cast("long").alias("characters")
    )
