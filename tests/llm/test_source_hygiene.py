import pytest

from quillspan.llm import source_hygiene as sh

SCHEMA = "file_id long, collection string, path string, length long, line_count int, sha256 string, head string, reasons string, dir string, name string"
CODE = "def f(x):\n    return x + 1\n"


def table(spark, rows):
    out = [(i, c, p, n, k, s, h, "clash", "clash", "clash") for i, (c, p, n, k, s, h) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def reasons(spark, *rows):
    return [r.reasons for r in sh.judged(table(spark, rows)).orderBy("file_id").collect()]


def one(spark, path="a/b.py", length=2000, lines=80, sha=None, head=CODE):
    return reasons(spark, ("r1", path, length, lines, sha, head))[0]


@pytest.mark.parametrize(
    "head",
    [
        "// @generated from x.schema\n" + CODE,
        "import a\n/* AUTO-GENERATED FILE, edits are overwritten on the next build */\n",
        "# Code generated by lexforge 0.6. DO NOT EDIT.\n",
        "<!-- Built from a.b by tool; run make to refresh -->\n",
        "// Output of schemac. Do not modify by hand.\n",
        "# THIS FILE WAS AUTOMATICALLY PRODUCED FROM X.DEF; CHANGES WILL BE LOST\n",
        "// Generated on 2024-05-15 by mill 1.0\n",
    ],
)
def test_generated_headers(spark, head):
    assert one(spark, head=head) == ["generated: header"]


@pytest.mark.parametrize(
    "path,head",
    [
        ("a/test_generated_key.py", "import unittest\nclass GeneratedKeyTest(unittest.TestCase):\n    pass\n"),
        ("a/generate_x.py", "# writes x.js; the output starts with a do-not-edit note\n" + CODE),
        ("a/b.c", "// please do not edit the order of these calls, the crest depends on it\n"),
        ("a/b.js", "/* MIT licence, see LICENSE in this project; same authors as the rest */\n"),
        ("a/vendor_page.py", CODE),
        ("a/external_chair/read.js", CODE),
        ("a/min_heron.html", CODE),
        ("a/b.min.js", CODE),
        ("a/b.js", "// rent tiers, typed in by hand\nconst RENT = [119, 131, 161, 172, 164, 250];\nexport const f = (p) =>\n  p.filter((x) => x.a > 7);\n"),
        ("a/b.py", None),
        ("a/b.py", ""),
        (None, CODE),
    ],
)
def test_hand_written(spark, path, head):
    assert one(spark, path=path, head=head) == [] == one(spark, path=path, head=head, length=None, lines=None)


@pytest.mark.parametrize(
    "path,head,length,lines,kind",
    [
        ("a/b.js", "var a=1;" * 60, 90_000, 2, "minified: dense lines"),
        ("a/b.js", "var a=1;" * 60, None, None, "minified: dense lines"),
        ("a/b.h", "const char b[] = {\n" + "  0xf8, 0xf2, 0x1e, 0x00,\n" * 15, 57_000, 590, "data: literal bulk"),
        ("a/b.ts", "export default `" + "5204fc2f96cf8a505c6d74d5e13106d081e7e70bfaec52c723af89771eb4b5e5\n" * 6, 9_000, 100, "data: literal bulk"),
        ("a/b.js", 'module.exports = [' + '[44,"table",0.4786],' * 20, 9_000, 100, "data: literal bulk"),
        ("a/gen/x.go", CODE, 2000, 80, "generated: output directory"),
        ("a/x_pb2.py", CODE, 2000, 80, "generated: output directory"),
        ("a\\node_modules\\x\\y.js", CODE, 2000, 80, "vendored: directory"),
        ("a/y.js", "/*!\n * gridkit v1.2.3\n * (c) the gridkit contributors, released under the MIT licence\n */\n", 2000, 80, "vendored: header"),
    ],
)
def test_kinds(spark, path, head, length, lines, kind):
    assert one(spark, path=path, length=length, lines=lines, head=head) == [kind]


def test_shared_trees_mark_copies(spark):
    got = reasons(
        spark,
        ("r1", "app/lib/kit-1.0/a.js", 10, 1, "S1", CODE),
        ("r1", "app/lib/kit-1.0/sub/b.js", 10, 1, "S2", CODE),
        ("r2", "./other//kit\\a.js", 10, 1, "s1", CODE),
        ("r2", "other/kit/sub/b.js", 10, 1, "s2", CODE),
        ("r1", "app/own.js", 10, 1, "s3", CODE),
        ("r1", "app/own.js", 10, 1, "s3", CODE),  # listed again in its own collection
        ("r1", "app/empty.js", 0, 0, "e0", ""),
        ("r2", "app/empty.js", 0, 0, "e0", ""),
        ("r3", "x.js", 10, 1, None, CODE),
        ("r4", "x.js", 10, 1, "", CODE),
        (None, "x.js", 10, 1, "s1", CODE),
    )
    assert [bool(r) for r in got] == [True] * 4 + [False] * 7
    assert got[0] == ["vendored: shared subtree"]


def test_merkle_hashes(spark):
    rows = [
        ("r1", "a/k/x", 1, 1, "1", ""), ("r1", "a/k/s/y", 1, 1, "2", ""), ("r2", "b/c/d/x", 1, 1, "1", ""), ("r2", "b/c/d/s/y", 1, 1, "2", ""),
        ("r3", "k/x", 1, 1, "2", ""), ("r3", "k/s/y", 1, 1, "1", ""), ("r4", "k/x", 1, 1, "1", ""), ("r4", "k/t/y", 1, 1, "2", ""),
    ]
    t = {(r.collection, r.dir): (r.h1, r.h2, r.n_files) for r in sh.merkle_directories(table(spark, rows)).collect()}
    assert t["r1", "a/k"] == t["r2", "b/c/d"] and t["r1", "a/k"][2] == 2
    assert len({t["r1", "a/k"], t["r3", "k"], t["r4", "k"]}) == 3
    assert t["r1", "a"] != t["r1", "a/k"] and t["r2", "b"][2] == 2
    shared = sh.shared_subtrees(table(spark, rows)).collect()
    assert {(r.n_collections, r.n_files) for r in shared} >= {(2, 2)}


def test_the_tree_alone_convicts(spark):
    """No path, header or layout tells; a directory copied whole does, and so do its small and empty members."""
    got = reasons(
        spark,
        ("r1", "src/parts/a.py", 900, 40, "p1", CODE), ("r1", "src/parts/__init__.py", 0, 0, "e0", ""), ("r1", "src/own.py", 900, 40, "q1", CODE),
        ("r2", "tools/read/a.py", 900, 40, "p1", CODE), ("r2", "tools/read/__init__.py", 0, 0, "e0", ""), ("r2", "tools/own.py", 900, 40, "q2", CODE),
        ("r3", "x/a.py", 900, 40, "p1", CODE), ("r3", "x/b.py", 900, 40, "q3", CODE), ("r3", "y/__init__.py", 0, 0, "e0", ""), ("r4", "z/__init__.py", 0, 0, "e0", ""),
    )
    yes, no = ["vendored: shared subtree"], []
    assert got == [yes, yes, no, yes, yes, no, yes, no, no, no]


def test_forks_and_homes_wrote_their_files(spark):
    base = [("src/a.py", "a"), ("src/b.py", "b"), ("lib/c.py", "c"), ("lib/d.py", "d")]
    row = lambda c, p, sha: (c, p, 900, 40, sha, CODE)
    fork = [row("main", *x) for x in base] + [row("fork", *x) for x in base] + [row("fork", "new/e.py", "e")]
    assert not any(reasons(spark, *fork))
    kit = [("a.js", "k1"), ("sub/b.js", "k2")]
    home = [row("kit", *x) for x in kit] + [row("app", f"code/kit/{p}", s) for p, s in kit] + [row("app", "main.js", "m")]
    assert [bool(r) for r in reasons(spark, *home)] == [False, False, True, True, False]
    both = [row("kit", *x) for x in kit] + [row(c, f"{c}/kit/{p}", s) for c in ("app", "web") for p, s in kit]
    assert [bool(r) for r in reasons(spark, *both)] == [False, False, True, True, True, True]


def test_deep_paths_and_unknown_contents(spark):
    deep = "/".join(f"d{i}" for i in range(400))
    got = reasons(
        spark,
        ("r1", f"{deep}/k/a.py", 900, 40, "p1", CODE), ("r1", f"{deep}/k/b.py", 900, 40, "p2", CODE), ("r2", "k2/a.py", 900, 40, "p1", CODE), ("r2", "k2/b.py", 900, 40, "p2", CODE),
        ("r3", "m/a.py", None, None, "p9", CODE), ("r3", "m/b.py", 900, 40, None, CODE), ("r4", "n/a.py", None, None, "P9 ", CODE), ("r4", "n/b.py", 900, 40, None, CODE),
    )
    assert [bool(r) for r in got] == [True, True, True, True, True, False, True, False]


def test_empty_table(spark):
    assert sh.judged(table(spark, [])).count() == 0
