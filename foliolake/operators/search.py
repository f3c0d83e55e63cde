"""Text search over paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The longest query, the most hits of a search, the reach and the cap of a snippet.
QUERY_LIMIT, HIT_LIMIT, REACH, SNIPPET_LIMIT = 512, 500, 48, 240


def positions(text: Column, query: str) -> Column:
    """Where a query begins, in characters from 0; hits don't overlap."""
    parts = F.split(text, "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    walk = F.aggregate(lengths, begin, lambda a, n: F.struct((a["at"] + n + len(query)).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found")))
    return F.when(F.contains(text, F.lit(query)), walk["found"]).otherwise(F.array().cast("array<int>"))


def folded(text: str) -> tuple[str, list[int]]:
    """Lower case with ß as ss, and for each folded character the place it comes from."""
    out, place = [], []
    for i, c in enumerate(text):
        f = "ss" if c in "ßẞ" else c.lower()
        out.append(f)
        place += [i] * len(f)
    return "".join(out), [*place, len(text)]


def locate_folded(text: str | None, query: str) -> list[tuple[int, int]]:
    """(start, end) of hits in any case, in characters of the text itself."""
    if not text or not query:
        return []
    t, place = folded(text)
    q, _ = folded(query)
    found, at = [], t.find(q)
    while at >= 0:
        last = place[at + len(q) - 1]
        found.append((place[at], last + 1))
        at = t.find(q, at + len(q))
    return found


def spans_folded(text: Column, query: str) -> Column:
    """Hits in any case. Folding can change lengths, so this maps back in an Arrow function."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts):
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in locate_folded(t, query)])

    return run(text)


def snippet(text: Column, start: Column, end: Column) -> Column:
    low = F.greatest(start - REACH, F.lit(0))
    high = F.least(end + REACH, F.length(text))
    body = F.translate(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), "\n", " ")
    whole = F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))
    return F.substring(whole, 1, SNIPPET_LIMIT)


def search(paragraphs: DataFrame, query: str, keys: list[str], text_col: str = "text", ignore_case: bool = False, max_hits: int = 100, per: list[str] | None = None) -> DataFrame:
    """(keys, hit_no, char_start, char_end, snippet, truncated): hits in the order of ``keys``, at most ``max_hits`` for each value of ``per`` (the first key).

    ``truncated`` says that the cap was reached, even if the last hit kept was the last there was."""
    if not 1 <= len(query) <= QUERY_LIMIT or not query.strip("\0"):
        raise ValueError(f"a query has 1 to {QUERY_LIMIT} characters")
    if not 1 <= max_hits <= HIT_LIMIT:
        raise ValueError(f"max_hits is from 1 to {HIT_LIMIT}")
    text = F.col(text_col)
    if ignore_case:
        spans = spans_folded(text, query)
        narrowed = paragraphs
    else:
        narrowed = paragraphs.where(F.contains(text, F.lit(query)))
        spans = F.transform(positions(text, query), lambda p: F.struct(p.alias("start"), (p + len(query)).alias("end")))
    hits = narrowed.select(*keys, text.alias("__text"), F.explode(spans).alias("__s"))
    per = per or keys[:1]
    order = [*keys, "__s.start"]
    ranked = hits.withColumn("hit_no", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    kept = ranked.where(F.col("hit_no") <= max_hits)
    return kept.select(
        *keys, "hit_no", F.col("__s.start").alias("char_start"), F.col("__s.end").alias("char_end"), snippet(F.col("__text"), F.col("__s.start"), F.col("__s.end")).alias("snippet"),
        (F.count("*").over(Window.partitionBy(*per)) >= max_hits).alias("truncated"),
    )


def hit_boxes(hits: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Hits with the box around the lines they touch; lines carry (char_start, char_end, bbox) within their paragraph."""
    from ..functions.geometry import union

    over = (F.col("h.char_start") < F.col("l.char_end")) & (F.col("l.char_start") < F.col("h.char_end"))
    same = [F.col(f"h.{k}") == F.col(f"l.{k}") for k in keys]
    joined = hits.alias("h").join(lines.alias("l"), [*same, over])
    return joined.groupBy(*(F.col(f"h.{c}") for c in hits.columns)).agg(union(F.col("l.bbox")).alias("bbox"))
