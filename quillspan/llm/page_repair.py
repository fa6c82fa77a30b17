"""Noise in text from scanned pages: running heads, page numbers, broken words, misread characters.

Method. A hidden Markov model labels the lines of each page as header, page number, paragraph break (the first line of a
paragraph) or body, from layout: what the line looks like (the notebook's title or a section, a number in a typical
dress), its place on the page, whether it stands alone, the gap before it, and whether its number runs with the page
numbers of the other pages. The model is fitted by Baum-Welch on a bounded sample of pages (``fit_pages``); every page is
decoded by Viterbi. Body lines are then joined: a broken word is closed, a misread character is judged against counts
of all words and word parts of the whole collection.

Scale. Counts go into two count-min sketches, of words and of word parts, twice as wide as there are keys and at most
3 x 2^22 cells each: what is broadcast is bounded, and packed, as most cells are small. Words inside a line are judged
where the line is read; what is shuffled, once, is a line's key, layout, first and last token (its whole text only where
the text is asked for), by packet, block of 64 pages and slice of 5,000 lines of a page, so that neither a packet nor a
page with a third of all rows meets in one task. Within a task lines stream page by page; the memory of a task is a block.
What stands at a border (the first and last body line, the open paragraphs) meets its neighbours in a second small shuffle
by packet, so that words and paragraphs read on across every border, whatever pages are missing or without text there.

Defined results
---------------
* A line delivered several times counts once (the latest delivery). Null or blank text is a body line without defect.
  Null page or line numbers order first. A null ``par_size``, ``gap_before`` or unknown notebook is an unknown feature.
* Lines equal in text are judged alike where their layout is alike. Empty tables give empty results; only the named
  columns are read, whatever else the input has.
* A broken word is a case only if a body line follows that goes on with a letter, and only if the corpus does not know
  the two parts better as a compound that keeps its hyphen.
* A word has at most 40 characters; a longer run without blanks is no word, is not counted and is no case. Parts are
  counted of words of 6 to 24 letters. A head or page number is a line of at most 64 characters in a paragraph of at most
  two lines.
* Beyond 2^21 distinct words cells of the sketch are shared as a rule; what the median cell holds is then taken off
  every count. Up to there a count is off only by chance, at every size of the input alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, spread

BLOCK_PAGES, SLICE_LINES, HALO_LINES = 64, 5000, 8
LEAST_BITS, MOST_BITS, DEPTH = 12, 22, 3

#: Characters that end the first half of a broken word.
BREAKS = "-‐­=¬"
#: Punctuation that is stripped from the edges of a word.
EDGES = "\"'.,;:!?()[]{}<>*/…“”‘’·—–" + BREAKS
#: Glyphs that scanning takes for others, what is read -> what stood there.
MISREADINGS = {
    "c": ["e"], "f": ["t"], "ri": ["n"], "cl": ["d"], "b": ["h"], "l": ["i"], "vv": ["w"], "v": ["y"], "rn": ["m"],
    "ii": ["u"], "lc": ["k"], "0": ["o"], "1": ["l", "i"], "5": ["s"], "6": ["b"], "9": ["g"], "8": ["b"],
    "ä": ["a"], "í": ["i"], "г": ["r"], "@": ["a"], "(": ["c"], "|": ["l", "i"], "\\/": ["v"],
    "d": ["cl"], "m": ["rn", "in"], "h": ["li"], "ﬁ": ["fi"], "ﬂ": ["fl"],
}
#: Marks that scanning inserts into words.
INSERTED = "^'~;.,`·"

_NUM = r"[0-9lIoOS|]{1,4}"
#: Dresses of a page number. A bare or bracketed figure may also be a figure of the text.
STRONG = (
    rf"^(?:(?:page|pg\.?|p\.)\s*{_NUM}|[-—–]\s*{_NUM}\s*[-—–]|\[\s*{_NUM}\s*\]|{_NUM}\s*/\s*{_NUM}"
    rf"|\.\s*{_NUM}\s*\.)$"
)
WEAK = rf"^(?:{_NUM}|\(\s*{_NUM}\s*\))$"
ROMAN = r"^(?:[ivxlc]{1,9}|[IVXLC]{1,9})$"


# ---- what the lines look like: Catalyst ---------------------------------------------------------------------------


def _squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def featured(lines: DataFrame, notebooks: DataFrame) -> DataFrame:
    """The columns that labelling needs: key, text, look (0 text, 1 title, 2 strong, 3 weak number) and number text."""
    names = F.transform(
        F.filter(F.concat(F.array("title"), F.coalesce("sections", F.array())), lambda x: F.length(_squash(x)) >= 4),
        _squash,
    )
    known = notebooks.groupBy("notebook_id").agg(F.array_distinct(F.flatten(F.collect_list(names))).alias("_names"))
    text = F.coalesce("text", F.lit(""))
    # only a short line that stands alone, or nearly so, can be a head or a number; the rest is not looked at
    short = (F.length(text) <= 64) & (F.coalesce("par_size", F.lit(1)) <= 2)
    bare = F.when(short, F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"[\^~;'@`]", ""))
    numbered = r"(?i)(?:\b(?:page|pg|p)\.?\s*)?\b[0-9lIoO|]{1,4}\b|^[ivxlc]+\s+(?=\S)|\s+[ivxlc]+$"
    joined = (
        lines.select(
            "packet_id", "page_no", "n", "notebook_id", "par_size", "gap_before", "received_at", text.alias("text"),
            bare.alias("_bare"),
        )
        .join(known, "notebook_id", "left")
        .withColumn("_key", _squash(F.col("_bare")))
        .withColumn("_key2", _squash(F.regexp_replace("_bare", numbered, "")))
    )

    def near(name: Column) -> Column:
        slack = F.greatest(F.lit(1), (F.length(name) / 5).cast("int"))

        def close(key: str) -> Column:
            return (F.abs(F.length(key) - F.length(name)) <= slack) & (F.levenshtein(F.col(key), name) <= slack)

        return close("_key") | close("_key2")

    look = (
        F.when(F.col("_bare").isNull(), 0)
        .when(F.col("_names").isNotNull() & F.coalesce(F.exists("_names", near), F.lit(False)), 1)
        .when(F.col("_bare").rlike("(?i)" + STRONG) & F.col("_bare").rlike(r"[0-9lI]") | F.col("_bare").rlike(ROMAN), 2)
        .when(F.col("_bare").rlike(WEAK) & F.col("_bare").rlike(r"[0-9lI]"), 3)
        .otherwise(0)
    )
    return joined.select(
        F.coalesce("packet_id", F.lit(-1)).alias("packet_id"),
        F.coalesce("page_no", F.lit(-1)).alias("page_no"),
        F.coalesce("n", F.lit(-1)).alias("n"),
        "par_size",
        "gap_before",
        F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("at"),
        "text",
        look.alias("look"),
    )


def blocked(lines: DataFrame) -> DataFrame:
    """Lines by (packet, block, slice); one shuffle, sorted within tasks.

    The first lines of a slice are copied into the slice before, marked ``ctx``: they show that the page goes on.
    """
    page, n = F.greatest("page_no", F.lit(0)), F.greatest("n", F.lit(0))
    blk, cut = F.floor(page / BLOCK_PAGES).cast("int"), F.floor(n / SLICE_LINES).cast("int")
    own = F.struct(blk.alias("blk"), cut.alias("slice"), F.lit(0).alias("ctx"))
    after_slice = F.when(
        (n % SLICE_LINES < HALO_LINES) & (cut > 0),
        F.struct(blk.alias("blk"), (cut - 1).alias("slice"), F.lit(1).alias("ctx")),
    )
    return (
        lines.select("*", F.inline(F.array_compact(F.array(own, after_slice))))
        .repartition("packet_id", "blk", "slice")
        .sortWithinPartitions("packet_id", "blk", "slice", "page_no", "n", F.desc("at"), "text")
    )


def raw_tokens(text: Column) -> Column:
    """What blanks separate; the first half of a broken word at the line's end is left out."""
    spaced = F.rtrim(F.translate(text, "\t\n\r\u00a0\u2009", "     "))
    cut_off = F.substring(spaced, -1, 1).isin(list(BREAKS))
    return F.split(F.when(cut_off, F.regexp_replace(spaced, r"\S+$", "")).otherwise(spaced), " ")


def word_counts(lines: DataFrame) -> DataFrame:
    """(k, c): lower-case words without edge punctuation. Tokens are counted as they stand, so that only distinct ones are trimmed."""
    tokens = lines.select(F.explode(raw_tokens(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    trimmed = tokens.select(F.btrim(F.lower("t"), F.lit(EDGES)).alias("k"), "c").where(F.length("k").between(1, 40))
    return trimmed.groupBy("k").agg(F.sum("c").alias("c"))


def _cells(keys: DataFrame, bits: int) -> np.ndarray:
    """Count-min sketch of (k, c): DEPTH rows of 2^bits cells, as many rows at most as reach the driver."""
    h, mask = F.xxhash64("k"), (1 << bits) - 1
    at = [F.shiftrightunsigned(h, d * 21).bitwiseAND(F.lit(mask)) + F.lit(d << bits) for d in range(DEPTH)]
    rows = keys.select("c", F.explode(F.array(*at)).alias("cell")).groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    sketch = np.zeros(DEPTH << bits, dtype=np.uint32)
    sketch[rows["cell"].to_numpy(dtype=np.int64)] = np.minimum(rows["c"].to_numpy(dtype=np.int64), (1 << 32) - 1)
    return sketch


def sketched(lines: DataFrame) -> tuple[bytes, bytes]:
    """Packed sketches of all words, and of the prefixes and suffixes of all distinct words."""
    words = cut(word_counts(lines))
    size = F.length("k")
    steps = F.sequence(F.lit(3), size - 3)
    parts = words.where(F.col("k").rlike(r"^\p{L}{6,24}$")).select(
        F.explode(
            F.concat(
                F.transform(steps, lambda i: F.concat(F.lit("p:"), F.substring("k", F.lit(1), i))),
                F.transform(steps, lambda i: F.concat(F.lit("s:"), F.substring("k", i + 1, size))),
            )
        ).alias("k")
    )
    parts = cut(parts.groupBy("k").agg(F.count(F.lit(1)).alias("c")))
    return tuple(zlib.compress(_cells(t, _bits(t.count())).tobytes(), 1) for t in (words, parts))


def _bits(keys: int) -> int:
    """Twice as many cells in a row as keys, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (2 * keys).bit_length()))


# ---- words -------------------------------------------------------------------------------------------------------


def _noise(sketch: np.ndarray) -> int:
    """What chance puts into a cell."""
    return int(np.median(sketch[: len(sketch) // DEPTH]))


def _counter(sketch: np.ndarray):
    """The count of a key, as a function."""
    width, get, floor = len(sketch) // DEPTH, sketch.item, _noise(sketch)
    mask = width - 1

    def count(key: str) -> int:
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        least = get(h & mask)
        for d in range(1, DEPTH):
            if not least:
                return 0
            least = min(least, get(((h >> (d * 21)) & mask) + d * width))
        return max(0, least - floor)

    return count


class _Raw(dict):
    """Whether a token as it stands in a line is misread; a memory only, judgements do not depend on it."""

    def __init__(self, lex: Lexicon) -> None:
        self.lex = lex

    def __missing__(self, token: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        w = _bare(token)
        out = self[token] = bool(w) and self.lex.judge(w) is not None
        return out


@dataclass
class Lexicon:
    """Counts of words and word parts, and the judgement of words by them, remembered per worker."""

    packed: tuple[bytes, bytes]
    memo: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        words, parts = (np.frombuffer(zlib.decompress(p), dtype=np.uint32) for p in self.packed)
        self.word, self.part = _counter(words), _counter(parts)
        self._floor = _noise(words)
        self.raw = _Raw(self)

    def shape(self, w: str) -> int:
        """How well ``w`` is made of known parts: the best cut's weaker part, in distinct words."""
        best = 0
        if 6 <= len(w) <= 24 and w.isalpha():
            for i in range(3, len(w) - 2):
                p = self.part("p:" + w[:i])
                if p > best and (s := self.part("s:" + w[i:])) > best:
                    best = min(p, s)
        return best

    def readings(self, w: str) -> list[str]:
        """What may have stood where ``w`` was read: one glyph undone, or one inserted mark dropped."""
        out = []
        for read, stood in MISREADINGS.items():
            at = w.find(read)
            while at >= 0:
                out += [w[:at] + s + w[at + len(read) :] for s in stood]
                at = w.find(read, at + 1)
        out += [w[:i] + w[i + 1 :] for i, ch in enumerate(w) if ch in INSERTED and 0 < i < len(w) - 1]
        return out

    def mended(self, w: str) -> str | None:
        """The lower-case word that was misread as ``w``, or None where ``w`` stands as read."""
        c = self.word(w)
        best, most = None, 0
        for v in self.readings(w):
            k = self.word(v)
            if k > most and k >= 8 * c and c <= 0.012 * k + 2 and k >= 4 + 2 * self._floor:
                best, most = v, k
        if best or not w.isascii() or len(w) < 6 or c > 50 + self._floor:
            return best
        own, most = self.shape(w), 0
        for v in self.readings(w):
            if v.isalpha() and (k := self.shape(v)) > most and k >= 12 and k >= 6 * own:
                best, most = v, k
        return best

    def judge(self, token: str) -> str | None:
        """The mended form of a stripped token (original case), or None."""
        if token in self.memo:
            return self.memo[token]
        out = self._judge(token)
        if len(self.memo) > 400_000:  # a memory only; judgements do not depend on it
            self.memo.clear()
        self.memo[token] = out
        return out

    def _judge(self, token: str) -> str | None:
        if len(token) > 40:
            return None
        w = token.lower()
        if token[0] == "(":  # an initial c read as a bracket; a bracket before a word that is known is one
            c, k = self.word(w[1:]), self.word("c" + w[1:])
            return "c" + w[1:] if k >= 8 * c + 4 else self.judge(token[1:])
        if w.isalpha() and w.isascii():
            if w == "l":
                return "I" if token == w and self.word("l") <= 0.02 * self.word("i") + 2 else None
            return self.mended(w) if len(w) > 1 else None
        if any(ch.isdigit() for ch in w):
            return self._figure(token, w)
        if re.fullmatch(r"[^\W\d_]+", w):  # a letter of another alphabet
            plain = "".join(MISREADINGS.get(ch, [ch])[0] if not ch.isascii() else ch for ch in w)
            known = self.word(w) > 0.02 * self.word(plain) + 3
            return plain if not known and plain != w else None
        if re.search(r"[\w]-[\w]|[\w]/[\w]", w) and not re.search(r"[\^~;@|\\(]", w):
            if self.word(w) > 20 + self._floor:
                return None
            bits = re.split(r"([-/])", token)
            mended = [(self.judge(b) if len(b) > 2 else None) for b in bits]
            return "".join(m or b for m, b in zip(mended, bits, strict=True)) if any(mended) else None
        if not re.search(r"[^\W\d_]", w):
            return None
        if (v := self.mended(w)) is not None:
            return v
        if re.search(r"\w[\^~;|@\\]+\w|^[@|\^~]\w|\w[@|\^~]$", w):
            plain = w
            for read in ("@", "|", "\\/"):
                plain = plain.replace(read, MISREADINGS[read][0])
            return re.sub(r"[\^~;\\]", "", plain)
        if m := re.fullmatch(r"([^\W\d_]+)[.'(,]([^\W\d_]+)", w):
            joined = m[1] + ("c" if "(" in w else "") + m[2]
            apart = min(self.word(m[1]), self.word(m[2]))
            if max(self.shape(joined), self.word(joined)) >= 4 and apart * 4 <= self.word(joined) + self.shape(joined):
                return joined
        return None

    def _figure(self, token: str, w: str) -> str | None:
        if re.fullmatch(r"[\d.,:/%+\-]+", w):
            return None
        if re.fullmatch(r"[A-Z]{1,3}-?\d+[a-z]?", token) or re.fullmatch(
            r"\d+(?:[.,:]\d+)?(?:st|nd|rd|th|s|h|am|pm|[a-kmnp-z]|mm|cm|kg|km|hz|khz|kb|mb|ms|uv|mv|x)", w
        ):
            return None
        if re.fullmatch(r"[\dlIoO|.,:/]+", token) and re.search(r"\d", token):
            return token.translate(str.maketrans("lI|oO", "11100"))
        letters = sum(ch.isalpha() for ch in w)
        plain = w
        for ch in "015698":
            plain = plain.replace(ch, MISREADINGS[ch][0])
        if (v := self.mended(w)) is not None:
            return v
        if plain.isalpha() and letters >= 2:
            alt = w.replace("1", "i")
            return max((plain, alt), key=lambda x: (self.word(x), self.shape(x))) if letters >= 3 else None
        return None


# ---- the model ---------------------------------------------------------------------------------------------------

HEADER, NUMBER, BREAK, BODY = range(4)
_LOOKS, _SLOTS, _ALONE, _GAPS, _RUNS = 4, 5, 2, 3, 3
SYMBOLS = _LOOKS * _SLOTS * _ALONE * _GAPS * _RUNS


def _prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initial log-free parameters: rows are header, number, break, body."""
    look = np.array([[0.02, 0.95, 0.01, 0.02], [0.01, 0.01, 0.70, 0.28], [0.975, 0.005, 0.002, 0.018], [0.985, 0.001, 0.001, 0.013]])
    slot = np.array([[0.70, 0.10, 0.02, 0.09, 0.09], [0.22, 0.10, 0.02, 0.02, 0.64], [0.09, 0.11, 0.70, 0.05, 0.05], [0.03, 0.04, 0.83, 0.05, 0.05]])
    alone = np.array([[0.03, 0.97], [0.03, 0.97], [0.75, 0.25], [0.97, 0.03]])  # no, yes
    gap = np.array([[0.60, 0.02, 0.38], [0.25, 0.02, 0.73], [0.15, 0.03, 0.82], [0.05, 0.93, 0.02]])  # unknown, small, large
    runs = np.array([[0.70, 0.25, 0.05], [0.30, 0.66, 0.04], [0.95, 0.005, 0.045], [0.97, 0.005, 0.025]])  # no number, runs, strays
    emit = np.einsum("sa,sb,sc,sd,se->sabcde", look, slot, alone, gap, runs).reshape(4, SYMBOLS)
    step = np.array([[0.05, 0.25, 0.50, 0.20], [0.25, 0.01, 0.54, 0.20], [0.02, 0.05, 0.28, 0.65], [0.02, 0.05, 0.18, 0.75]])
    start = np.array([0.45, 0.15, 0.25, 0.15])
    return start, step, emit


def _padded(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages as rows: (pages x longest) symbols, lengths, and the flat position of each cell."""
    bounds = np.append(first, len(symbols))
    length = np.diff(bounds)
    grid = np.full((len(first), int(length.max(initial=0))), -1, dtype=np.int64)
    at = np.arange(len(symbols)) - np.repeat(first, length)
    grid[np.repeat(np.arange(len(first)), length), at] = symbols
    return grid, length, at


def _weak_labels() -> np.ndarray:
    """SYMBOLS x 4: the states a line of that look may have been in, for fitting only.

    A line that is a title is a head, one in the dress of a page number is a number, one without either is text; a bare
    figure may be a number or text, which is what the layout must tell.
    """
    look = np.arange(SYMBOLS) // (SYMBOLS // _LOOKS)
    may = np.array([[0, 0, 1, 1], [1, 0, 0, 0], [0, 1, 0, 0], [0, 1, 1, 1]], dtype=float)
    return may[look]


def _possible(emit: np.ndarray) -> np.ndarray:
    """``emit`` without what the words rule out: a head looks like a title, a page number like a number."""
    look = np.arange(SYMBOLS) // (SYMBOLS // _LOOKS)
    may = np.array([[0, 0, 1, 1], [1, 0, 1, 1], [0, 1, 1, 1], [0, 1, 1, 1]], dtype=float)
    out = emit * may[look].T + 1e-12
    return out / out.sum(1, keepdims=True)


def fit(symbols: np.ndarray, first: np.ndarray, rounds: int = 6, weight: float = 200.0):
    """Baum-Welch from the prior, which counts as ``weight`` lines per state, so that rare symbols keep their meaning."""
    may = _weak_labels()
    start0, step0, emit0 = _prior()
    start, step, emit = start0.copy(), step0.copy(), emit0.copy()
    if len(symbols) == 0:
        return start, step, _possible(emit)
    grid, length, _ = _padded(symbols, first)
    pages, longest = grid.shape
    for _ in range(rounds):
        like = np.where(grid[..., None] >= 0, (emit.T * may)[np.maximum(grid, 0)], 1.0)
        a = np.zeros((longest, pages, 4))
        scale = np.ones((longest, pages))
        for t in range(longest):
            x = (start if t == 0 else a[t - 1] @ step) * like[:, t]
            scale[t] = x.sum(1)
            a[t] = x / scale[t][:, None]
        b = np.ones((pages, 4))
        n_start, n_step, n_emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, SYMBOLS))
        for t in range(longest - 1, -1, -1):
            live = length > t
            g = a[t] * b
            g /= g.sum(1, keepdims=True)
            for s in range(4):
                np.add.at(n_emit[s], grid[live, t], g[live, s])
            if t == 0:
                n_start += g.sum(0)
            else:
                right = like[:, t] * b / scale[t][:, None]
                both = live
                n_step += np.einsum("pi,ij,pj->ij", a[t - 1][both], step, right[both])
                b = np.where(live[:, None], right @ step.T, 1.0)
        start = n_start + weight * start0
        step = n_step + weight * step0
        emit = n_emit + weight * emit0
        start, step, emit = start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)
    return start, step, _possible(emit)


def decode(model, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most probable label of each line, all pages of a batch side by side."""
    if len(symbols) == 0:
        return np.zeros(0, dtype=np.int64)
    start, step, emit = (np.log(x) for x in model)
    grid, length, at = _padded(symbols, first)
    pages, longest = grid.shape
    back = np.zeros((longest, pages, 4), dtype=np.int8)
    score = start + emit.T[np.maximum(grid[:, 0], 0)]
    for t in range(1, longest):
        via = score[:, :, None] + step
        back[t] = via.argmax(1)
        new = via.max(1) + emit.T[np.maximum(grid[:, t], 0)]
        score = np.where((length > t)[:, None], new, score)
    path = np.zeros((longest, pages), dtype=np.int8)
    now = score.argmax(1)
    for t in range(longest - 1, -1, -1):
        path[t] = now
        if t:
            now = np.where(length > t, np.take_along_axis(back[t], now[:, None], 1)[:, 0], now)
    return path[at, np.repeat(np.arange(pages), length)].astype(np.int64)


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def _value(text: str, title: bool) -> int | None:
    """The page number that a line shows, misread figures included."""
    t = re.sub(r"[\^~;'@`]", "", text.strip())
    if title:
        m = re.search(r"(?:^|\s|\b)(\d{1,4})\b\.?(?:\s|$)", t)
        return int(m[1]) if m else None
    if re.fullmatch(ROMAN, t):
        total = prev = 0
        for ch in reversed(t.lower()):
            v = _ROMAN[ch]
            total += v if v >= prev else -v
            prev = max(prev, v)
        return total
    m = re.search(_NUM, re.sub(r"(?i)^(page|pg\.?|p\.)\s*", "", t))
    if not m:
        return None
    digits = m[0].translate(str.maketrans("lI|oOS", "111005"))
    return int(digits) if digits.isdigit() else None


def observe(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the lines of whole groups (sorted), and where each page begins."""
    group = f["group"].to_numpy()
    page = f["page_no"].to_numpy()
    look = f["look"].to_numpy()
    edge = np.ones(len(f), dtype=bool)
    edge[1:] = (group[1:] != group[:-1]) | (page[1:] != page[:-1])
    first = np.flatnonzero(edge)
    length = np.diff(np.append(first, len(f)))
    at = np.arange(len(f)) - np.repeat(first, length)
    left = np.repeat(length, length) - 1 - at
    slot = np.full(len(f), 2)
    slot[left == 1], slot[left == 0] = 3, 4
    slot[at == 1], slot[at == 0] = 1, 0
    alone = (f["par_size"].fillna(1).to_numpy() == 1).astype(int)
    gap = f["gap_before"].to_numpy(dtype=float)
    gaps = np.where(np.isnan(gap), 0, np.where(gap < 1.0, 1, 2))
    runs = np.zeros(len(f), dtype=int)
    shown = np.flatnonzero(look > 0)
    text = f["text"].to_numpy()
    offsets: dict = {}
    value = {}
    for i in shown:
        v = _value(text[i], look[i] == 1)
        if v is not None:
            value[i] = v - page[i]
            offsets.setdefault(group[i], {}).setdefault(v - page[i], set()).add(page[i])
    for i, off in value.items():
        votes = {o: len(p) for o, p in offsets[group[i]].items()}
        most = max(votes.values())
        runs[i] = 0 if most < 2 else (1 if votes[off] == most else 2)
    symbols = (((look * _SLOTS + slot) * _ALONE + alone) * _GAPS + gaps) * _RUNS + runs
    return symbols.astype(np.int64), first


# ---- the pass over the lines ---------------------------------------------------------------------------------------

_KEY = ["packet_id", "blk", "slice"]


def _groups(frames: Iterator[pd.DataFrame], least: int = 8000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups, each line once."""
    held: list[pd.DataFrame] = []
    rows = 0

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates([*_KEY, "page_no", "n", "ctx"], keep="first").reset_index(drop=True)
        k = f[_KEY].to_numpy()
        new = np.ones(len(f), dtype=bool)
        new[1:] = (k[1:] != k[:-1]).any(1)
        f["group"] = new.cumsum()
        return f

    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows < least:
            continue
        f = pd.concat(held, ignore_index=True)
        last = (f[_KEY].to_numpy() == f[_KEY].iloc[-1].to_numpy()).all(1)
        done = f[~last]
        if len(done):
            yield whole(done)
            held, rows = [f[last]], int(last.sum())
        else:
            held = [f]
    if held:
        yield whole(pd.concat(held, ignore_index=True))


_OPEN = re.compile(rf"([^\W\d_][\w'’]*(?:-[\w'’]+)*)[{re.escape(BREAKS)}]\s*$")
_ON = re.compile(r"\s*([^\W\d_][\w'’^~;@|]*)")


def _broken(lex: Lexicon, line: str, following: str) -> tuple[str, str, str] | None:
    """(first half, second half, mark) where the line's last word goes on in the following line, else None."""
    a, b = _OPEN.search(line), _ON.match(following)
    if not a or not b:
        return None
    head, tail, mark = a[1].lower().split("-")[-1], b[1].lower(), line.rstrip()[-1]
    stem = a[1].lower()
    closed, kept = lex.word(head + tail), lex.word(f"{head}-{tail}")
    if mark in "-‐" and "-" not in stem:
        if kept > closed:
            return None
        if not closed and not kept and min(lex.word(head), lex.word(tail)) >= 40 and lex.shape(head + tail) < 4:
            return None  # two words of their own
    elif kept > 4 * closed and kept > 3:
        return None
    return a[1], b[1], mark


def _bare(token: str) -> str:
    """The word in a token; an opening bracket that nothing closes stays, as it may be a letter."""
    w = token.strip(EDGES)
    return "(" + w if token[:1] == "(" and w and ")" not in token and len(w) > 2 else w


def _open(line: str) -> bool:
    return line.rstrip()[-1:] in BREAKS and bool(line.strip())


def _mend(lex: Lexicon, line: str, up, down, following: str | None) -> tuple[bool, bool, str]:
    """(broken at its end, misread, mended text) of a body line.

    ``up``, ``down``: what ``_broken`` says of the line before and this one, and of this one and ``following``.
    """
    fixed, misread, tokens = line, False, line.split()

    def joined(got) -> tuple[str, str | None, bool]:
        """The closed word's last part, its mended form, and whether it is misread in the first half."""
        head = got[0].split("-")[-1]
        whole = (head + got[1]).strip(EDGES)
        v = lex.judge(whole)
        if v is None:
            return whole, None, False
        w = whole.lower()
        at = next((k for k, (x, y) in enumerate(zip(w, v, strict=False)) if x != y), min(len(w), len(v)))
        return whole, v, at < len(head)

    if up:  # the second half has moved to the line before
        _, v, in_head = joined(up)
        misread = v is not None and not in_head
        fixed = (line.lstrip().split(None, 1) + [""])[1]
        tokens = tokens[1:]
    if down:
        a, b, _ = down
        head = a.split("-")[-1]
        whole, v, in_head = joined(down)
        misread |= in_head
        moved = following.lstrip().split(None, 1)[0]
        mended = v + moved[len(b) :] if v is not None and whole.islower() else head + moved
        if tokens:
            fixed = fixed[: fixed.rstrip().rfind(a)] + a[: len(a) - len(head)] + mended
        else:  # the line's only word has moved itself
            fixed = moved
        tokens = tokens[:-1]
    for x in tokens:
        if lex.raw[x]:
            t = _bare(x)
            v = lex.judge(t)
            misread = True
            shown = v if t.islower() or not t[:1].isalpha() else v[:1].upper() + v[1:] if not t.isupper() else v.upper()
            fixed = fixed.replace(t, shown, 1)
    return bool(down), misread, fixed


def narrowed(frames: Iterator[pd.DataFrame], lex: Lexicon) -> Iterator[pd.DataFrame]:
    """Lines that cannot be heads or numbers, cut down to first and last token; ``inner``: a word between is misread."""
    misread = lex.raw.__getitem__
    for f in frames:
        inner, texts = [False] * len(f), f["text"].tolist()
        for i in np.flatnonzero(f["look"].to_numpy() == 0).tolist():
            tokens = texts[i].split()
            if len(tokens) > 2:
                inner[i], texts[i] = any(map(misread, tokens[1:-1])), f"{tokens[0]} {tokens[-1]}"
        yield f.assign(text=texts, inner=inner)


def repair(frames: Iterator[pd.DataFrame], model, lex: Lexicon) -> Iterator[pd.DataFrame]:
    """Every line once: label, whether its last word is broken, whether a word was misread, and the mended text.

    Lines are judged within their segment: a run of lines that follow each other within the group. ``seg_page`` (its last
    page) and slice give the order of a packet's segments. A first body line of a segment, and a last one with an open
    word, carry ``text`` and the body lines beside it in the segment, for ``linked``.
    """
    for f in _groups(frames):
        symbols, first = observe(f)
        label = decode(model, symbols, first)
        text, inner = f["text"].tolist(), f["inner"].to_numpy()
        ctx, slices, page = f["ctx"].to_numpy(), f["slice"].to_numpy(), f["page_no"].to_numpy()
        fresh = np.append(True, np.diff(f["group"].to_numpy()[first]) != 0)
        goes_on = np.logical_or.reduceat(ctx > 0, first) if len(first) else np.zeros(0, dtype=bool)
        starts = fresh | (slices[first] > 0)
        starts[1:] |= goes_on[:-1]
        length = np.diff(np.append(first, len(f)))
        seg = np.repeat(starts.cumsum() - 1, length)
        ends = np.append(np.flatnonzero(starts)[1:], len(first)) - 1
        seg_page = page[first][ends][seg]
        # nothing stands before the first segment of a packet's first group
        opens = ~(fresh & (f["blk"].to_numpy()[first] == 0) & (slices[first] == 0))[starts]
        hyphen, misread = np.zeros(len(f), dtype=bool), np.zeros(len(f), dtype=bool)
        fixed = list(text)
        raw, before, after = [None] * len(f), [None] * len(f), [None] * len(f)
        at_first, at_last = np.zeros(len(f), dtype=bool), np.zeros(len(f), dtype=bool)
        body = [i for i in np.flatnonzero((label >= BREAK) & (ctx == 0)).tolist() if text[i].strip()]
        up = None
        for x, i in enumerate(body):
            h = body[x - 1] if x and seg[body[x - 1]] == seg[i] else None
            j = body[x + 1] if x + 1 < len(body) and seg[body[x + 1]] == seg[i] else None
            is_open = _open(text[i])
            down = _broken(lex, text[i], text[j]) if j is not None and is_open else None
            hyphen[i], misread[i], fixed[i] = _mend(lex, text[i], up, down, None if j is None else text[j])
            misread[i] |= inner[i]
            up = down
            at_first[i], at_last[i] = h is None and opens[seg[i]], j is None and is_open
            if at_first[i] or at_last[i]:
                raw[i], before[i], after[i] = text[i], None if h is None else text[h], None if j is None else text[j]
        yield pd.DataFrame(
            {
                "packet_id": f["packet_id"],
                "page_no": f["page_no"],
                "n": f["n"],
                "blk": f["blk"],
                "slice": f["slice"],
                "label": label,
                "hyphen": hyphen,
                "misread": misread,
                "mended": fixed,
                "seg_page": seg_page,
                "seg": seg,
                "opens": opens[seg],
                "at_first": at_first,
                "at_last": at_last,
                "inner": inner,
                "text": pd.Series(raw, dtype=object),
                "before": pd.Series(before, dtype=object),
                "after": pd.Series(after, dtype=object),
            }
        )[ctx == 0]


def linked(lines: list[dict], lex: Lexicon) -> None:
    """Judges a packet's lines at borders (in order) anew where a word is broken across the border."""
    got = [
        _broken(lex, x["text"], y["text"]) if x["at_last"] and y["at_first"] else None
        for x, y in zip(lines, lines[1:], strict=False)
    ]
    for k, x in enumerate(lines):
        over, under = got[k - 1] if k else None, got[k] if k < len(got) else None
        if not over and not under:
            continue
        up = over or (_broken(lex, x["before"], x["text"]) if x["before"] and _open(x["before"]) else None)
        down = under or (_broken(lex, x["text"], x["after"]) if x["after"] and _open(x["text"]) else None)
        following = lines[k + 1]["text"] if under else x["after"]
        x["hyphen"], x["misread"], x["mended"] = _mend(lex, x["text"], up, down, following)
        x["misread"] |= x["inner"]


def _bordering(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[dict]]]]:
    """Of frames sorted by (edge, packet, order): the rows away from borders, and the rows at borders, whole packets."""
    held: list[dict] = []
    for f in frames:
        edge = f["edge"].to_numpy(dtype=bool)
        done: list[list[dict]] = []
        # a packet has a few of these for each block of pages
        for r in f[edge].astype(object).where(f[edge].notna(), None).to_dict("records"):
            if held and held[-1]["packet_id"] != r["packet_id"]:
                done.append(held)
                held = []
            held.append(r)
        yield f[~edge], done
    if held:
        yield f[:0], [held]


def _by_packet(rows: DataFrame, *order: str) -> DataFrame:
    """Rows at borders by packet, in order; the others spread."""
    return rows.repartition("edge", "packet_id", F.when(~F.col("edge"), F.col(order[-2]))).sortWithinPartitions(
        "edge", "packet_id", "seg_page", "slice", *order
    )


LABELS = ["header", "page_number", "break", "body"]
_OUT = (
    "packet_id long, page_no int, n int, blk int, slice int, label int, hyphen boolean, misread boolean, mended string"
)
_EDGE = "at_first boolean, at_last boolean, inner boolean, text string, before string, after string"


_LINE = "packet_id long, page_no int, n int, par_size int, gap_before double, at long, text string, look int, inner boolean"


def fitted(lines: DataFrame, notebooks: DataFrame, fit_pages: int = 1500, fit_lines: int = 60_000):
    """The model, from whole pages: at most ``fit_pages``, of smallest hash, with at most ``fit_lines`` lines in all."""
    sizes = lines.groupBy("packet_id", "page_no").agg(F.count(F.lit(1)).alias("c"))
    rows = sizes.where("packet_id is not null and page_no is not null").orderBy(F.xxhash64("packet_id", "page_no")).take(fit_pages)
    room, kept = fit_lines, []
    for packet, page, c in rows:
        if c <= room:
            kept.append((packet, page))
            room -= c
    if not kept:
        return fit(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    pages = lines.sparkSession.createDataFrame(kept, "packet_id long, page_no int")
    picked = lines.join(F.broadcast(pages), ["packet_id", "page_no"], "left_semi")  # at most fit_pages rows
    sample = (
        featured(picked, notebooks)
        .withColumns({"blk": F.lit(0), "slice": F.lit(0), "ctx": F.lit(0)})
        .toPandas()
        .sort_values(["packet_id", "page_no", "n", "at"])
    )
    return fit(*observe(next(_groups(iter([sample]), least=1 << 60))))


def _passed(lines: DataFrame, notebooks: DataFrame, fit_pages: int, narrow: bool):
    """The lines in blocks, the model, and the broadcast sketches."""
    model = fitted(lines, notebooks, fit_pages)
    lines = spread(lines.select("packet_id", "page_no", "n", "notebook_id", "par_size", "gap_before", "received_at", "text"))
    # a bounded number of cells, whatever the size of the corpus
    held = lines.sparkSession.sparkContext.broadcast(sketched(lines.select(F.coalesce("text", F.lit("")).alias("text"))))
    seen = featured(lines, notebooks)
    if narrow:
        seen = seen.mapInPandas(lambda frames: narrowed(frames, Lexicon(held.value)), _LINE)
    else:
        seen = seen.withColumn("inner", F.lit(False))
    return blocked(seen), model, held


def repaired(lines: DataFrame, notebooks: DataFrame, fit_pages: int = 1500, defects_only: bool = False) -> DataFrame:
    """One row per line (with ``defects_only``, per line with a defect): its label, defects and mended text."""
    base, model, held = _passed(lines, notebooks, fit_pages, defects_only)
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in repair(frames, model, Lexicon(held.value)):
            f["edge"] = f["text"].notna()
            if defects_only:
                f = f[(f["label"] < BREAK) | f["hyphen"] | f["misread"] | f["edge"]].copy()
                f.loc[~f["edge"], "mended"] = None
            yield f.drop(columns=["seg", "opens"])

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(held.value)
        for plain, packets in _bordering(frames):
            yield plain[names]
            for rows in packets:
                linked(rows, lex)
                yield pd.DataFrame(rows)[names]

    judged = base.mapInPandas(run, f"{_OUT}, seg_page int, {_EDGE}, edge boolean")
    return _by_packet(judged, "page_no", "n").mapInPandas(settle, _OUT)


def found(lines: DataFrame, notebooks: DataFrame) -> DataFrame:
    """(packet_id, page_no, n, defect)."""
    r = repaired(lines, notebooks, defects_only=True)
    defects = F.array_compact(
        F.array(
            F.when(F.col("label") == HEADER, F.lit("header")),
            F.when(F.col("label") == NUMBER, F.lit("page_number")),
            F.when(F.col("hyphen"), F.lit("hyphen")),
            F.when(F.col("misread"), F.lit("misread")),
        )
    )
    return r.select("packet_id", "page_no", "n", F.explode(defects).alias("defect"))


def _runs_on(label: int, page: int, last_page: int, so_far: str) -> bool:
    return label == BODY or (page != last_page and not re.search(r"[.!?\"”]\s*$", so_far))


_PIECE = "packet_id long, first_page int, first_n int, n_lines int, mended string, label int, last_page int, edge boolean, hard boolean"


def pieces(f: pd.DataFrame) -> pd.DataFrame:
    """Repaired lines of whole segments as paragraphs; ``edge``: may go on beyond the segment.

    Lines at a border stay by themselves, as their text may change. ``hard``: begins a paragraph, whatever stands before.
    """
    names = [c.split()[0] for c in f"{_PIECE}, {_PLACE}, {_EDGE}".split(", ")]
    f = f[(f["label"] >= BREAK) & ((f["mended"].str.strip() != "") | f["text"].notna())]
    seg, border = f["seg"].to_numpy(), f["text"].notna().to_numpy()
    label, page, mended = f["label"].tolist(), f["page_no"].tolist(), f["mended"].str.strip().tolist()
    first: list[int] = []  # the line that a piece begins with, and what the piece holds
    held: list[list[str]] = []
    last: list[int] = []
    hard: list[bool] = []
    edge: list[bool] = []
    opens = f["opens"].to_numpy()
    inner = None  # the piece of the segment's lines away from borders that is being put together
    for i in range(len(f)):
        if i == 0 or seg[i] != seg[i - 1]:
            if inner is not None:
                edge[inner] = True
            inner = None
        if border[i]:
            first.append(i), held.append([mended[i]]), last.append(page[i]), hard.append(False), edge.append(True)
        elif inner is not None and _runs_on(label[i], page[i], last[inner], held[inner][-1]):
            held[inner].append(mended[i])
            last[inner] = page[i]
        else:
            first.append(i), held.append([mended[i]]), last.append(page[i]), hard.append(inner is not None)
            edge.append(inner is None and bool(opens[i]))
            inner = len(first) - 1
    if inner is not None:
        edge[inner] = True
    out = f.iloc[first].rename(columns={"page_no": "first_page", "n": "first_n"})
    return out.assign(n_lines=[len(h) for h in held], mended=[" ".join(h) for h in held], last_page=last, edge=edge, hard=hard)[names]


_PLACE = "seg_page int, slice int, hyphen boolean, misread boolean"


def paragraphs(lines: DataFrame, notebooks: DataFrame) -> DataFrame:
    """(packet_id, first_page, first_n, n_lines, text): the readable paragraphs, in order, across pages.

    A paragraph ends where the next line is labelled break, but not at a page border inside a sentence. Paragraphs are put
    together within a block of pages; those at its borders meet their neighbours by packet.
    """
    base, model, held = _passed(lines, notebooks, 1500, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in repair(frames, model, Lexicon(held.value)):
            yield pieces(f)

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(held.value)
        names = ["packet_id", "first_page", "first_n", "n_lines", "mended"]
        for plain, packets in _bordering(frames):
            rows: list[dict] = []
            for own in packets:
                linked([r for r in own if r["text"] is not None], lex)
                last: dict | None = None
                for r in own:
                    r["mended"] = r["mended"].strip()
                    if not r["mended"]:
                        continue
                    if last and not r["hard"] and _runs_on(r["label"], r["first_page"], last["last_page"], last["mended"]):
                        last["n_lines"] += r["n_lines"]
                        last["mended"] += " " + r["mended"]
                        last["last_page"] = r["last_page"]
                    else:
                        last = r
                        rows.append(r)
            both = pd.concat([plain[names], pd.DataFrame(rows, columns=names)]) if rows else plain[names]
            yield both.rename(columns={"mended": "text"})

    judged = base.mapInPandas(run, f"{_PIECE}, {_PLACE}, {_EDGE}")
    return _by_packet(judged, "first_page", "first_n").mapInPandas(
        settle, "packet_id long, first_page int, first_n int, n_lines int, text string"
    )
