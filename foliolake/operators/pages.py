"""Page assembly: extraction, splitting, merging, order, insertion. Pages carry (doc, page_index from 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: pages that one insertion copies, at most.
INSERT_LIMIT = 200


def renumber(pages: DataFrame, doc: str, order: list[Column], index: str = "page_index") -> DataFrame:
    """Indices from 0 in the given order."""
    return pages.withColumn(index, F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)


def extract(pages: DataFrame, indices: list[int], doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    """The listed pages, in the list's order; a page may be listed again."""
    if not indices:
        raise ValueError("no pages are listed")
    places = F.array(*(F.lit(i) for i in indices))
    hit = F.filter(F.transform(places, lambda p, k: F.struct(p.alias("page"), k.alias("at"))), lambda x: x["page"] == F.col(index))
    return pages.withColumn("__at", F.explode(hit)).withColumn(index, F.col("__at.at")).drop("__at")


def split(pages: DataFrame, size: int, index: str = "page_index") -> DataFrame:
    """``part`` from 0 and the index within it, ``size`` pages a part."""
    if size < 1:
        raise ValueError("a part has a page at least")
    return pages.withColumn("part", F.floor(F.col(index) / size).cast("int")).withColumn(index, (F.col(index) % size).cast("int"))


def split_ranges(pages: DataFrame, ranges: list[tuple[int, int]], index: str = "page_index") -> DataFrame:
    """A part for each inclusive range; ranges may overlap."""
    if any(a > b or a < 0 for a, b in ranges):
        raise ValueError("a range runs from its first to its last page")
    parts = F.array(*(F.struct(F.lit(k).alias("part"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in enumerate(ranges)))
    own = pages.withColumn("__r", F.explode(F.filter(parts, lambda r: F.col(index).between(r["low"], r["high"]))))
    return own.withColumn("part", F.col("__r.part")).withColumn(index, (F.col(index) - F.col("__r.low")).cast("int")).drop("__r")


def merge(documents: list[DataFrame], doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    """One document from several page tables, one after the other: rows of a table are ordered by (doc, index)."""
    if not documents:
        raise ValueError("nothing to merge")
    whole = None
    for k, d in enumerate(documents):
        d = d.withColumn("__k", F.lit(k))
        whole = d if whole is None else whole.unionByName(d)
    # Sizes of what stands before are few rows; only they meet.
    sizes = whole.groupBy("__k", doc).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__k", doc).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = whole.withColumn("__i", F.row_number().over(Window.partitionBy("__k", doc).orderBy(index)) - 1).join(before.drop("__n"), ["__k", doc])
    return placed.withColumn(index, (F.col("__before") + F.col("__i")).cast("long")).drop("__k", "__i", "__before")


def delete(pages: DataFrame, indices: list[int], doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    """Without the listed pages; a document that would lose all keeps them, with ``status`` saying so."""
    gone = F.col(index).isin(*set(indices)) if indices else F.lit(False)
    own = Window.partitionBy(doc)
    marked = pages.withColumn("__left", F.sum((~gone).cast("int")).over(own))
    kept = marked.withColumn("status", F.when(F.col("__left") == 0, "CANNOT_DELETE_ALL").otherwise("OK")).where(~gone | (F.col("__left") == 0)).drop("__left")
    return renumber(kept, doc, [F.col(index)], index)


def reorder(pages: DataFrame, order: list[int], doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    """New page k is old page ``order[k]``; documents of another length, and orders that are no permutation, are an error."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("the new order is no permutation")
    where = F.array(*(F.lit(order.index(i)) for i in range(len(order))))
    total = F.count("*").over(Window.partitionBy(doc))
    fits = pages.withColumn("__n", total)
    checked = F.when(F.col("__n") == len(order), F.get(where, F.col(index).cast("int"))).otherwise(F.raise_error(F.lit("the order has another number of pages than the document")).cast("int"))
    return fits.withColumn(index, checked).drop("__n")


def reverse(pages: DataFrame, doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    return renumber(pages, doc, [F.col(index).desc()], index)


def insert(pages: DataFrame, new: DataFrame, at: int, doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    """``new`` (same columns, its own indices from 0, at most INSERT_LIMIT a document) put before page ``at``."""
    count = new.groupBy(doc).agg(F.count("*").alias("__n"))
    room = pages.join(count, doc, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    room = room.withColumn("__n", F.when(F.col("__n") > INSERT_LIMIT, F.raise_error(F.lit("too many pages in one insertion")).cast("long")).otherwise(F.col("__n")))
    moved = room.withColumn(index, F.when(F.col(index) >= at, F.col(index) + F.col("__n")).otherwise(F.col(index)).cast("long")).drop("__n")
    return moved.unionByName(new.withColumn(index, (F.col(index) + at).cast("long")))


def duplicate(pages: DataFrame, page: int, at: int, doc: str = "doc_id", index: str = "page_index") -> DataFrame:
    return insert(pages, pages.where(F.col(index) == page).withColumn(index, F.lit(0).cast("long")), at, doc, index)


def rotate(rotation: Column, delta: int) -> Column:
    from ..functions.geometry import normal_rotation

    return normal_rotation(rotation + F.lit(delta))
