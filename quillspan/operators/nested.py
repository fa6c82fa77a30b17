"""Nested packet deliveries -> related flat tables of paragraphs, lines and words.

Each delivery carries a tree of paragraphs > lines > words, either typed (``paragraphs``) or as JSON (``body``).
One projection of higher-order functions per target table walks the tree: nested ``transform`` calls attach the
ancestors' keys and positions, ``flatten`` joins the levels and one ``inline`` emits the rows. There is no shuffle and
no Python: a delivery is one row, so the plan is scan -> project -> generate, whatever the size or skew of the input.

Defined results
---------------
* Positions start at 0 within the parent, in the order delivered. Null and blank elements give no row and keep their
  position; an object or string standing alone where a list is expected is the element at position 0. Paragraphs are
  counted on through all pages of a delivery.
* ``body`` may be JSON, or a JSON string that holds JSON (one level). Text that does not parse to its end, a null
  ``body`` beside null ``paragraphs`` and scalars give no rows. Where both are given, ``paragraphs`` is taken.
* Unknown members are ignored; a member of the wrong type counts as absent. Ids are kept as delivered (null, repeated):
  the link from child to parent is ``(delivery_id, par_pos, line_pos)``, not the id.
* Empty tables give empty tables; extra columns of the input are ignored, whatever their names. Repeated deliveries give
  their rows once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def _elements(v: Column, path: str) -> Column:
    """The list at ``path`` as array<variant>; a lone element becomes a list of one, anything absent null."""
    lone = F.try_variant_get(v, path, "variant")
    return F.coalesce(
        F.try_variant_get(v, path, "array<variant>"),
        F.when(lone.isNotNull() & ~F.is_variant_null(lone), F.array(lone)),
    )


def _given(v: Column, value: Column) -> Column:
    """``value`` unless the element is null or JSON's null."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), value)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _word_v(w: Column) -> Column:
    return _given(w, F.struct(
        _get(w, "$.id", "string").alias("id"),
        # a bare string is the word itself; schema_of_variant tells it from an object
        F.when(F.schema_of_variant(w).startswith("OBJECT"), _get(w, "$.text", "string"))
        .otherwise(_get(w, "$", "string"))
        .alias("text"),
        _get(w, "$.bbox", _BOX).alias("bbox"),
        _get(w, "$.conf", "double").alias("conf"),
    ))


def _line_v(ln: Column) -> Column:
    return _given(ln, F.struct(
        _get(ln, "$.id", "string").alias("id"),
        _get(ln, "$.n", "int").alias("n"),
        _get(ln, "$.text", "string").alias("text"),
        _get(ln, "$.bbox", _BOX).alias("bbox"),
        _get(ln, "$.conf", "double").alias("conf"),
        _get(ln, "$.gap_before", "double").alias("gap_before"),
        _get(ln, "$.kind", "string").alias("kind"),
        _get(ln, "$.raw", "string").alias("raw"),
        F.transform(_elements(ln, "$.words"), _word_v).alias("words"),
    ))


def _par_v(p: Column, page: Column | None = None) -> Column:
    own = _get(p, "$.page", "int")
    return _given(p, F.struct(
        _get(p, "$.id", "string").alias("id"),
        (F.coalesce(own, page) if page is not None else own).alias("page"),
        _get(p, "$.bbox", _BOX).alias("bbox"),
        F.transform(_elements(p, "$.lines"), _line_v).alias("lines"),
    ))


def parsed(packets: DataFrame) -> DataFrame:
    """(delivery_id, tree): the paragraphs of each readable delivery in one typed shape, pages laid end to end."""
    outer = F.try_parse_json("body")
    # a JSON string that holds JSON is unwrapped once; told by its first character, so that others are parsed once
    root = F.when(F.col("body").rlike(r'^\s*"'), F.try_parse_json(_get(outer, "$", "string"))).otherwise(outer)
    v = packets.select("delivery_id", "paragraphs", root.alias("_root"))
    root = F.col("_root")
    paged = F.flatten(
        F.transform(
            _elements(root, "$.pages"),
            lambda pg: F.transform(
                F.coalesce(_elements(pg, "$.paragraphs"), _none("variant")), lambda p: _par_v(p, _get(pg, "$.n", "int"))
            ),
        )
    )
    straight = F.transform(_elements(root, "$.paragraphs"), lambda p: _par_v(p))
    return v.select("delivery_id", F.coalesce(F.col("paragraphs"), straight, paged).alias("tree"))


def _present(x: Column) -> Column:
    return x.isNotNull()


def paragraphs(packets: DataFrame) -> DataFrame:
    """One row per paragraph: (delivery_id, par_pos, page, par_id, bbox, n_lines)."""
    rows = F.transform(
        "tree",
        lambda p, i: F.struct(
            i.alias("par_pos"),
            _present(p).alias("_here"),
            p["page"].alias("page"),
            p["id"].alias("par_id"),
            p["bbox"].alias("bbox"),
            F.coalesce(F.size(F.filter(p["lines"], _present)), F.lit(0)).alias("n_lines"),
        ),
    )
    return _emit(packets, rows)


def lines(packets: DataFrame) -> DataFrame:
    """One row per line, linked to its paragraph by (delivery_id, par_pos)."""
    rows = F.flatten(
        F.transform(
            "tree",
            lambda p, i: F.coalesce(
                F.transform(
                    p["lines"],
                    lambda ln, j: F.struct(
                        i.alias("par_pos"),
                        j.alias("line_pos"),
                        _present(ln).alias("_here"),
                        p["page"].alias("page"),
                        p["id"].alias("par_id"),
                        ln["id"].alias("line_id"),
                        ln["n"].alias("n"),
                        ln["text"].alias("text"),
                        ln["raw"].alias("raw"),
                        ln["kind"].alias("kind"),
                        ln["conf"].alias("conf"),
                        ln["gap_before"].alias("gap_before"),
                        ln["bbox"].alias("bbox"),
                        F.coalesce(F.size(F.filter(ln["words"], _present)), F.lit(0)).alias("n_words"),
                    ),
                ),
                F.array(),
            ),
        )
    )
    return _emit(packets, rows)


def words(packets: DataFrame) -> DataFrame:
    """One row per word with non-blank text, linked to its line by (delivery_id, par_pos, line_pos)."""
    rows = F.flatten(
        F.flatten(
            F.transform(
                "tree",
                lambda p, i: F.coalesce(
                    F.transform(
                        p["lines"],
                        lambda ln, j: F.coalesce(
                            F.transform(
                                ln["words"],
                                lambda w, k: F.struct(
                                    i.alias("par_pos"),
                                    j.alias("line_pos"),
                                    k.alias("word_pos"),
                                    w["text"].rlike(r"(?U)\S").alias("_here"),
                                    p["id"].alias("par_id"),
                                    ln["id"].alias("line_id"),
                                    w["id"].alias("word_id"),
                                    w["text"].alias("text"),
                                    w["conf"].alias("conf"),
                                    w["bbox"].alias("bbox"),
                                ),
                            ),
                            F.array(),
                        ),
                    ),
                    F.array(),
                ),
            )
        )
    )
    return _emit(packets, rows)


def _emit(packets: DataFrame, rows: Column) -> DataFrame:
    # filtered before the generator, so that no blank element becomes a row
    kept = F.filter(rows, lambda r: F.coalesce(r["_here"], F.lit(False)))
    return parsed(packets).select("delivery_id", F.inline(kept)).drop("_here")
