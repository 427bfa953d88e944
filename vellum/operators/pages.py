"""Plans of made-up pages: where lines and their parts stand, for layouts of running text, invoices, forms, tables and lists.

Everything is set by the page's number, so plans are the same in every run; glyph widths are one ``advance`` a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import fit_words
from vellum.operators.corpus import unit

#: The first x of a line's text, from and to.
LEFT = {"paragraph": (20, 40), "invoice": (20, 30), "form": (20, 40), "list": (25, 35), "header": (25, 35)}


def between(key: Column, name: str, lo: int | Column, hi: int | Column) -> Column:
    """A whole number from lo to hi, both included, set by the key's hash."""
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return (lo + F.floor(unit(key, name) * (hi - lo + 1))).cast("int")


def plan(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, line, part, x, y) of pages (page_id, layout, width, height, line_height, ascent, advance); a page's columns named
    in ``keep`` come along.

    Lines: one for heights up to 128, two to four up to 256, else five to twelve, as many as fit; spaced by a fifth to half
    of a line, 5 at least; none that would reach into the lower margin. Parts: 0 is the text, label, item, bullet or first
    cell; a form's value stands behind its label, an invoice's amount (eight characters) at the right edge, a list's text
    20 after its bullet, a table's cells in two to four columns; a header's first line is a title in the middle,
    10 further from the next.
    """
    k = F.col("page_id")
    tall = F.greatest(F.col("line_height"), F.lit(20))
    spacing = F.greatest(F.lit(5), between(k, "spacing", (tall * F.lit(0.2)).cast("int"), (tall * F.lit(0.5)).cast("int")))
    p = pages.withColumns({"tall": tall, "spacing": spacing, "upper": between(k, "upper", 15, 30), "lower": between(k, "lower", 15, 30)})
    most = F.greatest(F.lit(1), F.floor((F.col("height") - F.col("upper") - F.col("lower")) / (F.col("tall") + F.col("spacing"))).cast("int"))
    some = lambda lo, hi: between(k, "lines", F.lit(lo), F.greatest(F.lit(lo), F.least(F.lit(hi), most)))
    lines = F.when(F.col("height") <= 128, 1).when(F.col("height") <= 256, some(2, 4)).otherwise(some(5, 12))
    top = F.greatest(F.lit(10), F.col("upper") + F.greatest(F.col("ascent"), F.lit(10)))
    top = F.when(top > F.col("height") - 50, 30).otherwise(top)
    p = p.withColumns({"top": top, "line": F.explode(F.sequence(F.lit(0), lines - 1))})
    y = F.col("top") + F.col("line") * (F.col("tall") + F.col("spacing")) + F.when((F.col("layout") == "header") & (F.col("line") > 0), 10).otherwise(0)
    p = p.withColumn("y", y).where(F.col("y") + F.col("tall") <= F.col("height") - F.col("lower"))

    each = F.concat_ws("/", k.cast("string"), F.col("line").cast("string"))
    draw = lambda name, lo, hi: between(each, name, lo, hi)
    left = F.lit(None).cast("int")
    for layout, (lo, hi) in LEFT.items():
        left = F.when(F.col("layout") == layout, draw("left", lo, hi)).otherwise(left)
    columns = between(k, "columns", 2, 4)
    wide = F.floor(F.col("width") / columns).cast("int")
    cells = F.transform(F.sequence(F.lit(0), columns - 1), lambda c: c * wide + between(F.concat_ws("/", each, c.cast("string")), "cell", 10, 15))
    title = F.greatest(F.lit(20), F.least(F.floor((F.col("width") - F.col("advance") * 12) / 2), F.col("width") - F.col("advance") * 12 - 20)).cast("int")
    xs = (
        F.when(F.col("layout") == "invoice", F.array(left, F.col("width") - 8 * F.col("advance") - draw("right", 20, 30)))
        .when(F.col("layout") == "form", F.array(left, left + draw("label", 4, 10) * F.col("advance") + draw("gap", 10, 20)))
        .when(F.col("layout") == "table", cells)
        .when(F.col("layout") == "list", F.array(left, left + 20))
        .when((F.col("layout") == "header") & (F.col("line") == 0), F.array(title))
        .otherwise(F.array(left))
    )
    return p.select("page_id", *keep, "line", F.posexplode(xs).alias("part", "x"), "y").select("page_id", *keep, "line", "part", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def fill(plans: DataFrame, texts: DataFrame, advance: int, width: int, margin: int = 20) -> DataFrame:
    """Plans with texts (page_id, line, part, text), see fit. Both have many rows a page, which the sizes that joins are
    planned by don't show: neither is broadcast."""
    return fit(plans.join(texts.hint("merge"), ["page_id", "line", "part"]), advance, width, margin)


def fit(filled: DataFrame, advance: int, width: int, margin: int = 20) -> DataFrame:
    """Plans that have their ``text``: words that would reach beyond the right margin go, but two stay; the boxes of what is
    left."""
    words = F.split("text", " ")
    upto = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.length(F.array_join(F.slice(words, 1, n), " ")) * advance)
    kept = filled.withColumn("text", F.array_join(fit_words(words, upto, F.lit(width - margin) - F.col("x")), " "))
    order = F.row_number().over(W.partitionBy("page_id").orderBy("y", "x", "part"))
    return kept.select("page_id", order.alias("ordinal"), "line", "part", "text", "x", "y", (F.length("text") * advance).alias("w"))
