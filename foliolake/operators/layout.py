"""Glyphs to spans to lines to paragraphs over whole corpora, with windows and folds; one shuffle by page serves all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import union
from .cluster import islands, previous

PAGE = ["doc_id", "page_index"]


def spans(glyphs: DataFrame) -> DataFrame:
    """(page keys, span_id, text, bbox, font, font_size, rendered_size, baseline_y): runs of glyphs on a baseline in one face, with no gap of two and a half sizes."""
    p = lambda c: previous(c, PAGE, ["seq"])
    gap = F.col("x") - (p("x") + p("advance"))
    apart = (
        (F.abs(F.col("y") - p("y")) >= 1) | (F.col("font") != p("font")) | (F.abs(F.col("font_size") - p("font_size")) >= 0.5) | (F.col("node") != p("node"))
        | (gap >= 2.5 * F.greatest(p("rendered_size"), p("font_size")))
    )
    runs = islands(glyphs, PAGE, ["seq"], apart, "span_id")
    first = lambda c: F.min_by(c, "seq").alias(c)
    out = runs.groupBy(*PAGE, "span_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "unicode"))).alias("g"), union(F.col("bbox")).alias("bbox"), first("font"), first("font_size"), first("rendered_size"), F.min_by("y", "seq").alias("baseline_y")
    )
    return out.select(*PAGE, "span_id", F.array_join("g.unicode", "").alias("text"), "bbox", "font", "font_size", "rendered_size", "baseline_y")


def lines(found: DataFrame) -> DataFrame:
    """(page keys, line_id, text, bbox, baseline_y, font, rendered_size): spans within a fifth of the size of their line's first span, top to bottom.

    A fold, since each span is held against the first of its line, not against the one before."""
    row = F.struct((-F.col("baseline_y")).alias("down"), F.col("bbox.min_x").alias("x"), "span_id", "text", "bbox", "font", F.greatest("rendered_size", "font_size").alias("visual"), "rendered_size")
    pages = found.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        new = (acc["n"] < 0) | (F.abs(s["down"] - acc["down"]) > acc["room"])
        n = F.when(new, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(n.alias("n"), F.when(new, s["down"]).otherwise(acc["down"]).alias("down"), F.when(new, 0.2 * s["visual"]).otherwise(acc["room"]).alias("room"), F.concat(acc["ids"], F.array(n)).alias("ids"))

    begin = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("down"), F.lit(0.0).alias("room"), F.array().cast("array<int>").alias("ids"))
    each = pages.select(*PAGE, F.explode(F.arrays_zip(F.col("s"), F.aggregate("s", begin, step)["ids"].alias("id"))).alias("z"))
    each = each.select(*PAGE, F.col("z.id").alias("line_id"), F.col("z.s").alias("s"))
    own = each.groupBy(*PAGE, "line_id").agg(F.sort_array(F.collect_list(F.struct("s.x", "s.span_id", "s.text", "s.bbox", "s.visual", "s.font", "s.rendered_size", "s.down"))).alias("s"), union(F.col("s.bbox")).alias("bbox"))

    def join(acc: Column, s: Column) -> Column:
        space = (acc["end"].isNotNull()) & (s["bbox"]["min_x"] - acc["end"] > 0.25 * s["visual"]) & ~acc["text"].endswith(" ") & ~s["text"].startswith(" ")
        return F.struct(F.concat(acc["text"], F.when(space, " ").otherwise(""), s["text"]).alias("text"), s["bbox"]["max_x"].alias("end"))

    text = F.aggregate("s", F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end")), join)["text"]
    return own.select(*PAGE, "line_id", text.alias("text"), "bbox", (-F.col("s")[0]["down"]).alias("baseline_y"), F.col("s")[0]["font"].alias("font"), F.col("s")[0]["rendered_size"].alias("rendered_size"))


def paragraphs(found: DataFrame) -> DataFrame:
    """(page keys, paragraph_id, text, bbox, line_count, leading): lines that follow each other in one face and overlap across, or are only the second of their paragraph."""
    pages = found.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_id", "baseline_y", "bbox", "font", "rendered_size", "text"))).alias("s"))

    def step(acc: Column, s: Column) -> Column:
        p = acc["last"]
        tall = F.greatest(p["bbox"]["max_y"] - p["bbox"]["min_y"], s["bbox"]["max_y"] - s["bbox"]["min_y"])
        dy = p["baseline_y"] - s["baseline_y"]
        face = (p["font"] == s["font"]) & (F.abs(p["rendered_size"] - s["rendered_size"]) < 0.5)
        meets = (s["bbox"]["min_x"] <= p["bbox"]["max_x"]) & (s["bbox"]["max_x"] >= p["bbox"]["min_x"])
        stays = (acc["n"] >= 0) & (dy > 0) & (dy <= 2.2 * tall) & face & (meets | (acc["size"] < 2))
        n = F.when(stays, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(n.alias("n"), F.when(stays, acc["size"] + 1).otherwise(1).alias("size"), s.alias("last"), F.concat(acc["ids"], F.array(n)).alias("ids"))

    begin = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("size"), F.col("s")[0].alias("last"), F.array().cast("array<int>").alias("ids"))
    each = pages.select(*PAGE, F.explode(F.arrays_zip(F.col("s"), F.aggregate("s", begin, step)["ids"].alias("id"))).alias("z")).select(*PAGE, F.col("z.id").alias("paragraph_id"), F.col("z.s").alias("s"))
    own = each.groupBy(*PAGE, "paragraph_id").agg(F.sort_array(F.collect_list(F.struct("s.line_id", "s.text", "s.baseline_y"))).alias("s"), union(F.col("s.bbox")).alias("bbox"))
    height = F.col("bbox.max_y") - F.col("bbox.min_y")
    drop = F.col("s")[0]["baseline_y"] - F.element_at("s", -1)["baseline_y"]
    n = F.size("s")
    return own.select(*PAGE, "paragraph_id", F.array_join("s.text", "\n").alias("text"), "bbox", n.alias("line_count"), F.when(n > 1, drop / (n - 1)).otherwise(1.2 * height).alias("leading"))
