"""Planted defects in pages of a notebook: recall and precision of each kind."""

import random
from collections import Counter

import pytest

from quillspan.llm import page_repair as pr

SCHEMA = "packet_id long, notebook_id long, page_no int, n int, par_size int, gap_before double, text string, received_at timestamp"
WORDS = (
    "harbour willow marsh heron lantern kitchen garden window morning evening winter summer orchard thicket meadow bramble copper "
    "ladder pocket letter paper candle bottle basket cellar attic chimney hammer needle thread blanket pillow feather mountain valley "
    "river bridge station platform carriage engine whistle signal ticket journey village market butcher baker miller sailor captain "
    "anchor rudder compass island current weather thunder shadow silver golden crimson yellow narrow hollow gentle patient quiet "
    "different beautiful remember forgotten yesterday tomorrow together afterwards something everything nothing between without "
    "watched listened wandered gathered carried followed answered wondered travelled whispered finished started opened closed"
).split()
#: What stood there -> what is read; undone by the operator's own table.
ERRORS = [("e", "c"), ("m", "rn"), ("d", "cl"), ("o", "0"), ("h", "b"), ("w", "vv"), ("n", "ri"), ("k", "lc"), ("u", "ii")]


def misread(rng, word):
    able = [(a, b) for a, b in ERRORS if a in word[1:-1]]
    if not able:
        return None
    a, b = rng.choice(able)
    i = word.index(a, 1)
    return word[:i] + b + word[i + 1 :]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(12)
    rows, truth = [], set()
    for packet in range(1, 13):
        carried = ""
        for page in range(1, 25):
            n = 0

            def put(text, size, gap, *defects, packet=packet, page=page):
                nonlocal n
                n += 1
                rows.append((packet, 1, page, n, size, None if n == 1 else gap, text, None))
                truth.update((packet, page, n, d) for d in defects)

            if rng.random() < 0.8:
                put(rng.choice(["THE HARBOUR BOOK", "The Harbour Book", f"The Harbour Book {page}", "Tides and Rain"]), 1, 1.6, "header")
            for _ in range(3):
                size = rng.randrange(3, 6)
                for k in range(size):
                    tokens = [rng.choice(WORDS) for _ in range(rng.randrange(6, 10))]
                    defects = []
                    if rng.random() < 0.05:  # one error of a word is rare beside the word
                        i = rng.randrange(1, len(tokens) - 1)
                        if bad := misread(rng, tokens[i]):
                            tokens[i] = bad
                            defects.append("misread")
                    if carried:
                        tokens.insert(0, carried)
                        carried = ""
                    if rng.random() < 0.15:
                        whole = rng.choice([w for w in WORDS if len(w) >= 7])
                        at = rng.randrange(3, len(whole) - 2)
                        tokens.append(whole[:at] + rng.choice(["-", "-", "¬", "="]))
                        carried = whole[at:]
                        defects.append("hyphen")
                    put(" ".join(tokens), size, 1.6 if k == 0 else 0.4, *defects)
            put(rng.choice([f"— {page} —", f"[{page}]", f"p. {page}", f"{page}"]), 1, 1.6, "page_number")
        if carried:  # nothing follows the packet's last line
            last = max((x for x in truth if x[0] == packet and x[3] == "hyphen"), key=lambda x: (x[1], x[2]))
            truth.discard(last)
    lines = spark.createDataFrame(rows, SCHEMA)
    books = spark.createDataFrame([(1, "The Harbour Book", ["Tides and Rain"])], "notebook_id long, title string, sections array<string>")
    return truth, {tuple(r) for r in pr.found(lines, books).collect()}


@pytest.mark.parametrize("defect", ["header", "page_number", "hyphen", "misread"])
def test_recall_and_precision_of_each_defect(planted, defect):
    truth, got = ({x for x in s if x[3] == defect} for s in planted)
    assert len(truth) > 80
    missed, wrong = truth - got, got - truth
    assert len(truth & got) >= 0.9 * len(truth), (Counter(x[3] for x in missed), sorted(missed)[:5])
    assert len(truth & got) >= 0.95 * len(got), sorted(wrong)[:5]
