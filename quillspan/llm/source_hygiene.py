"""Generated, minified, vendored and data files in listings of code collections.

Method. Every listing is a leaf of its collection's directory tree. Merkle hashes are computed bottom-up over the trees;
a subtree (a leaf included) that hangs in unrelated collections was written by neither of them: vendored. Rules over the
head and the layout of a file catch what was generated, minified or is data. Only where the trees are silent, because a
copy hangs in one collection alone, do its header or a conventional directory name tell that it is one.

Unrelated are collections of different origin. A collection of which more than half of the files hang in directories that
another has at the same place with the same files is a fork or mirror of it: both have one origin, and what they share was
not copied in from elsewhere. A collection whose whole tree hangs as a directory in others is that package's home: it wrote
its files itself.

The hash of a directory is a multiset hash, the exclusive or of keyed hashes of its members: first of its own files (name,
content), then, per directory, of that hash and the way down to it, for every directory above. Both combine before the
shuffle, so that a directory with a third of all files is no hot group; no list of children is ever collected, and the
number of steps does not depend on how deep the trees are.

Defined results
---------------
* A file listed again is judged again, under each id. Paths are compared with ``/`` for ``\\``, without ``./``, doubled
  slashes and outer blanks, and in lower case for the rules.
* Null ``length`` or ``line_count``: layout is judged by the head alone. Null or empty ``head``: by path and hash. Null
  path: by hash and head. A null or empty ``sha256`` equals no other; a directory with such a file equals none. Empty files
  tell nothing, neither alone nor where a directory has no others. Null collections share nothing.
* Names alone convict nobody but in the directories that by convention hold copies or output: a ``.min.`` file must be
  dense, ``generate_x`` and ``vendor_x`` are hand-written until their content says otherwise.
* Empty tables give empty results; extra columns are ignored; several reasons of one file are all recorded, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.session import cut, spread

#: The reason that the trees give.
SHARED = "vendored: shared subtree"
#: The share of its files that a collection must have in common with another, place by place, to be of its origin.
FORK_SHARE = 0.5
#: Rows (two names) of the table of forks that a broadcast may have.
BROADCAST_FORKS = 100_000
#: Directories that by convention hold copies of others' code.
VENDOR_DIRS = "vendor|vendored|third_party|thirdparty|third-party|node_modules|bower_components|site-packages|extern|external|deps"
#: Directories and names that by convention hold the output of a tool.
OUTPUT_PATH = r"(^|/)(gen|generated|__generated__|build/output|out)/|(^|/)dist/[^/]*\.bundle\.[^/]*$|_(pb2?|autogen|generated)\.[a-z]+$|\.(g|gen|generated|pb|designer)\.[a-z]+$"

_COMMENT = r"(?m)^[ \t]*(?://|#(?!include|define)|/\*+!?|\*|<!--|--|;)[ \t]*"
#: What a tool writes on top of its output. Each holds a marker and what a person who merely mentions it leaves out.
GENERATED = "|".join(
    [
        r"@generated\b",
        r"\b(?:this file (?:is|was) )?auto-?\s?generated\b(?! by hand)",
        r"\bautomatically (?:generated|produced|created|written) (?:from|by|with)\b",
        r"\bmachine-(?:written|generated|made) by\b",
        r"\bcode generated by\b",
        r"^generated (?:on|by|from|with) \S",
        r"\boutput of \S+ do not (?:modify|edit)",
        r"\bcreated with \S+ [\d.]+ from\b",
        r"^built from \S+ by\b",
        r"\bedits are overwritten\b|\b(?:changes|edits) will be lost\b",
        r"\bdo not (?:edit|modify)(?: (?:this file|by hand))?\s*[.!]?\s*(?:\*/|-->)?$",
    ]
)
COPIED = "|".join(
    [
        r"\bupstream copy\b",
        r"@licen[sc]e \S+ v?\d",
        r"\bcopyright (?:\(c\) )?(?:\d{4} )?the \S+ (?:contributors|authors|developers)\b",
        r"\(c\) (?:\d{4} )?the \S+ (?:contributors|authors|developers)\b",
    ]
)
#: A line longer than this, or more bytes a line on average, is not typed by hand.
LONG_LINE, DENSE_BYTES = 160, 110


def clean_path(path: Column) -> Column:
    p = F.regexp_replace(F.trim(path), r"\\+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.regexp_replace(p, r"^(\./)+|^/|/(?=$)", "")


def _comments(head: Column) -> Column:
    """The comment lines of the head, lower case, without their markers."""
    lines = F.filter(F.split(F.lower(head), "\n"), lambda x: x.rlike(_COMMENT))
    return F.transform(lines, lambda x: F.regexp_replace(x, _COMMENT, ""))


def _longest_line(head: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(head, "\n"), F.length)), F.lit(0))


def file_rules() -> tuple[Column, Column]:
    """Two array<string> of reasons that a file's own columns give, in a fixed order: of files that nobody wrote, and of
    copies, for where the trees are silent."""
    path, head = F.lower(F.col("_path")), F.coalesce("head", F.lit(""))
    comments = _comments(head)
    bytes_a_line = F.col("length") / F.when(F.col("line_count") > 0, F.col("line_count"))
    size = F.length(head)
    # what remains of the head without figures, hex dumps and what separates them
    rest = F.regexp_replace(head, r"(?:0x[0-9a-fA-F]+|\b(?=[a-f]*[0-9])[0-9a-f]{40,}\b|-?\b\d+(?:\.\d+)?\b)[\s,;]*", "")
    rows = F.regexp_count(head, F.lit(r"\[\s*-?\d[\d.]*\s*,\s*\"[^\"]*\"\s*,\s*-?\d[\d.]*\s*\]"))
    data = (
        ((size >= 60) & (F.length(rest) < 0.5 * size))
        | head.rlike(r"[A-Za-z0-9+/]{200,}={0,2}")
        | (rows >= 6)
    )
    dense = (_longest_line(head) >= LONG_LINE) & (F.coalesce(bytes_a_line, F.lit(1e9)) >= DENSE_BYTES) | (
        (bytes_a_line >= 4 * DENSE_BYTES) & (_longest_line(head) >= LONG_LINE / 2)
    )
    unwritten = F.array(
        F.when(F.exists(comments, lambda c: c.rlike(GENERATED)), "generated: header"),
        F.when(path.rlike(OUTPUT_PATH), "generated: output directory"),
        F.when(data, "data: literal bulk"),
        F.when(dense & ~data, "minified: dense lines"),
    )
    copied = F.array(
        F.when(F.exists(comments, lambda c: c.rlike(COPIED)), "vendored: header"),
        F.when(path.rlike(rf"(^|/)({VENDOR_DIRS})/"), "vendored: directory"),
    )
    none = F.array().cast("array<string>")
    return F.coalesce(F.array_compact(unwritten), none), F.coalesce(F.array_compact(copied), none)


# ---- Merkle trees -----------------------------------------------------------------------------------------------


def _both(name: str, *cols: Column) -> list[Column]:
    """Two 64-bit keyed hashes, ``name``1 and ``name``2."""
    return [F.xxhash64(F.lit(seed), *cols).alias(f"{name}{seed}") for seed in (1, 2)]


def placed(files: DataFrame) -> DataFrame:
    """Listings as leaves: the keys of collection, directory (d), leaf (l) and content (c), and whether it tells alone."""
    path, sha = clean_path(F.col("path")), F.lower(F.trim("sha256"))
    known = F.coalesce(sha != "", F.lit(False))
    content = F.when(known, sha).otherwise(F.concat_ws("/", F.lit("?"), "collection", path))
    directory = F.regexp_replace(path, r"/?[^/]*$", "")
    return files.select(
        "*",
        directory.alias("_dir"),
        F.xxhash64("collection").alias("_col"),
        *_both("_d", F.xxhash64("collection"), directory),
        *_both("_l", F.regexp_extract(path, r"([^/]*)$", 1), content),
        *_both("_c", content),
        (known & F.col("collection").isNotNull() & F.coalesce(F.col("length") > 0, F.lit(True))).alias("_tells"),
    )


def own_directories(files: DataFrame) -> DataFrame:
    """(_col, dir, o1, o2, own_files, telling) of the directories that hold files; a file listed twice counts once."""
    leaves = placed(files.where("collection is not null and path is not null")).groupBy("_col", F.col("_dir").alias("dir"), "_l1", "_l2")
    return (
        leaves.agg(F.max("_tells").alias("_tells"))
        .groupBy("_col", "dir")
        .agg(F.bit_xor("_l1").alias("o1"), F.bit_xor("_l2").alias("o2"), F.count(F.lit(1)).alias("own_files"), F.count_if("_tells").alias("telling"))
    )


def _upwards(own: DataFrame) -> DataFrame:
    """A row for each directory and each directory above it, itself and the root included: keys a1, a2 and the way down."""
    names = F.filter(F.split("dir", "/"), lambda x: x != "")
    depth = F.size("_n")
    return own.withColumn("_n", names).select(
        "*",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), depth),
                lambda k: F.struct(
                    F.array_join(F.slice("_n", F.lit(1), k), "/").alias("above"),
                    F.array_join(F.slice("_n", k + 1, depth), "/").alias("way"),
                ),
            )
        ).alias("_u"),
    ).select("*", *_both("a", F.col("_col"), F.col("_u.above")), (F.col("_u.above") == "").alias("root"))


def _trees(own: DataFrame) -> DataFrame:
    """(_col, a1, a2, root, h1, h2, n_files, telling): key, Merkle hash and size of every directory.

    The name a directory goes by is no part of its own hash, so ``lib-1.0`` and ``lib`` with equal content are equal.
    """
    return _upwards(own).groupBy("_col", "a1", "a2", "root").agg(*_sums())


def _sums() -> list[Column]:
    hashes = [F.bit_xor(F.xxhash64(F.lit(k + 2), "_u.way", "o1", "o2")).alias(f"h{k}") for k in (1, 2)]
    return [*hashes, F.sum("own_files").alias("n_files"), F.sum("telling").alias("telling")]


def merkle_directories(files: DataFrame) -> DataFrame:
    """(collection, dir, h1, h2, n_files): the Merkle hash and size of every directory by its path."""
    up = _upwards(own_directories(files)).withColumn("dir", F.col("_u.above"))
    names = files.select("collection", F.xxhash64("collection").alias("_col")).where("collection is not null").distinct()
    return up.groupBy("_col", "dir").agg(*_sums()).join(names, "_col").select("collection", "dir", "h1", "h2", "n_files")


def origins(own: DataFrame) -> DataFrame:
    """(_col, origin) of the collections that are forks or mirrors of another."""
    place = ["_p", "o1", "o2"]
    at = own.select("_col", F.xxhash64("dir").alias("_p"), "o1", "o2", "own_files")
    common = at.groupBy(*place).agg(F.min("_col").alias("origin"), F.max("_col").alias("_m")).where("origin < _m").drop("_m")
    shared = at.join(common, place).where("_col != origin").groupBy("_col", "origin").agg(F.sum("own_files").alias("n"))
    total = own.groupBy("_col").agg(F.sum("own_files").alias("total"))
    # more than half can be of one origin only
    return shared.join(total, "_col").where(F.col("n") > FORK_SHARE * F.col("total")).select("_col", "origin")


def _with_origin(df: DataFrame, forks: DataFrame) -> DataFrame:
    """``df`` with ``origin``. ``forks`` is materialised, so that counting it costs nothing."""
    few = forks.count() <= BROADCAST_FORKS
    return df.join(F.broadcast(forks) if few else forks, "_col", "left").withColumn("origin", F.coalesce("origin", "_col"))


def _unrelated(df: DataFrame, *key: str) -> DataFrame:
    """``key`` and ``inside`` (not only as a root) of what collections of different origin hold."""
    both = df.groupBy(*key).agg(F.min("origin").alias("_a"), F.max("origin").alias("_b"), (~F.min("root")).alias("inside"))
    return both.where("_a < _b").drop("_a", "_b")


def shared_subtrees(files: DataFrame) -> DataFrame:
    """(h1, h2, n_collections, n_files): directory contents found in unrelated collections."""
    own = cut(own_directories(files))
    trees = _with_origin(_trees(own).where("telling > 0"), cut(origins(own)))
    per = trees.groupBy("h1", "h2", "_col").agg(F.max("n_files").alias("n_files"), F.max("origin").alias("origin"))
    held = per.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_collections"), F.max("n_files").alias("n_files"), (F.min("origin") < F.max("origin")).alias("_apart")
    )
    return held.where("_apart").drop("_apart")


def vendored_places(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_d1, _d2, home): directories in or under a subtree that unrelated collections share, and all directories of the
    homes of such subtrees; and (_c1, _c2): contents that unrelated collections share."""
    own = cut(own_directories(files))
    forks = cut(origins(own))
    trees = cut(_with_origin(_trees(own).where("telling > 0"), forks))
    hung = cut(trees.join(_unrelated(trees, "h1", "h2"), ["h1", "h2"]).select("_col", "a1", "a2", "root", "inside"))
    homes = hung.where("root and inside").select("_col").distinct()
    roots = hung.where("not root").select("a1", "a2")
    d = _both("_d", F.col("_col"), F.col("dir"))
    under = _upwards(own).join(roots, ["a1", "a2"], "left_semi").select(*d, F.lit(False).alias("home"))
    at_home = own.join(homes, "_col", "left_semi").select(*d, F.lit(True).alias("home"))
    marked = under.unionByName(at_home).groupBy("_d1", "_d2").agg(F.max("home").alias("home"))
    alone = placed(files).where("_tells").select("_col", "_c1", "_c2", F.lit(False).alias("root"))
    return marked, _unrelated(_with_origin(alone, forks), "_c1", "_c2").drop("inside")


def judged(files: DataFrame) -> DataFrame:
    """(file_id, collection, path, reasons, handwritten) for every listing."""
    unwritten, copied = file_rules()
    files = spread(files.select("file_id", "collection", "path", "length", "line_count", "sha256", "head"))
    leaves = placed(files).withColumn("_path", clean_path(F.col("path")))
    base = leaves.select("file_id", "collection", "path", "_d1", "_d2", "_c1", "_c2", "_tells", unwritten.alias("_unwritten"), copied.alias("_copied"))
    marked, single = vendored_places(files)
    out = base.join(marked, ["_d1", "_d2"], "left").join(single.withColumn("_single", F.lit(True)), ["_c1", "_c2"], "left")
    # the mark of a directory says false (a copy), true (at home) or nothing
    shared = ~F.coalesce("home", ~(F.col("_tells") & F.col("_single").isNotNull()))
    reasons = F.concat("_unwritten", F.when(shared, F.array(F.lit(SHARED))).otherwise(F.col("_copied")))
    return out.select("file_id", "collection", "path", reasons.alias("reasons")).withColumn("handwritten", F.size("reasons") == 0)
