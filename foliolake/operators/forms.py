"""Labels for form fields, and candidates against what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def nearest_before(fields: DataFrame, labels: DataFrame, keys: list[str], field: str, label: str, at: str, place: str) -> DataFrame:
    """(field, label): the nearest label at or before a field on one axis, the smaller label on ties. One sort of both sides; no pairs are made."""
    rows = fields.select(*keys, F.col(at).alias("__t"), F.col(field).alias("__f"), F.lit(None).cast("long").alias("__l")).unionByName(labels.select(*keys, F.col(place).alias("__t"), F.lit(None).cast("long").alias("__f"), F.col(label).alias("__l")))
    # Labels of one place stand before its fields, the smallest last, so that the last label seen is the one.
    own = Window.partitionBy(*keys).orderBy("__t", F.col("__f").isNotNull(), F.desc("__l")).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("__last", F.last("__l", ignorenulls=True).over(own))
    return seen.where(F.col("__f").isNotNull() & F.col("__last").isNotNull()).select(F.col("__f").alias(field), F.col("__last").alias(label))


def label_distance(box: Column, line: Column, baseline: Column, is_square: Column) -> Column:
    """How far a line is as a box's label; null if it can't be one. To the left, above (half as far again), and for squares to the right."""
    middle = lambda r: (r["min_y"] + r["max_y"]) / 2
    apart = F.abs(middle(line) - middle(box))
    left = box["min_x"] - line["max_x"]
    is_left = (left >= -5) & (left <= 150) & ((apart <= 14) | baseline.between(box["min_y"] - 4, box["max_y"] + 4))
    up = line["min_y"] - box["max_y"]
    is_above = (up >= -4) & (up <= 28) & line["min_x"].between(box["min_x"] - 30, box["max_x"])
    right = line["min_x"] - box["max_x"]
    is_right = is_square & (right >= -4) & (right <= 160) & (apart <= 12)
    return F.least(F.when(is_left, left), F.when(is_above, up * 1.5), F.when(is_right, right))


def label_boxes(boxes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` (keys, candidate_id, rect, is_square) with label, suggested_name, field_type, confidence; ``lines`` (keys, line_id, text, bbox, baseline_y)."""
    near = boxes.join(lines, keys).withColumn("__d", label_distance(F.col("rect"), F.col("bbox"), F.col("baseline_y"), F.col("is_square")))
    best = near.where("__d is not null and trim(text) <> ''").groupBy(*keys, "candidate_id").agg(F.min_by("text", F.struct("__d", "line_id")).alias("__text"))
    out = boxes.join(best, [*keys, "candidate_id"], "left").withColumn("label", F.nullif(T.clean_label(F.col("__text")), F.lit(""))).drop("__text")
    name = F.when(F.col("label").isNotNull(), T.identifier(F.col("label"))).otherwise(F.concat(F.lit("Field_"), F.col("candidate_id")))
    return out.select(
        "*", name.alias("suggested_name"), T.field_type(F.col("is_square"), F.col("label")).alias("field_type"),
        T.field_confidence(F.col("is_square"), F.col("label"), G.width(F.col("rect")), G.height(F.col("rect"))).alias("confidence"),
    )


def without_taken(candidates: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that no existing field (keys, field_rect) covers: overlap over 0.4, or the centre inside."""
    taken = (G.iou(F.col("rect"), F.col("field_rect")) > 0.4) | G.centre_inside(F.col("rect"), F.col("field_rect"))
    return candidates.join(fields, [*(candidates[k] == fields[k] for k in keys), taken], "left_anti")


def unique_names(fields: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """``_2``, ``_3``, … after names that stand before already."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    return fields.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat(F.col(name), F.lit("_"), F.col("__n"))).otherwise(F.col(name))).drop("__n")
