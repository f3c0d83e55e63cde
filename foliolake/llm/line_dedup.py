"""Line de-duplication across documents.

Hashes of normalised lines are dealt by range on (hash, document) with a secondary sort, largest document first, and a
stream over each sorted partition keeps the first document of every key. A key that touches the edge of a partition (so
any key too large for one) is decided from a per-key summary, which combines before it is
shuffled: the distinct documents of the key, whose number and largest are all that is kept. Nothing carries text: the operator returns a compressed keep bitmap for each document.

Defined cases. A null or empty text is one empty line, which is never dropped. A line's key is the line without
``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; keys under ``min_chars`` code points never drop. A document
is its id: rows that repeat an id count once, and all rows of the largest id keep their lines. Rows with a null id
neither count nor lose lines. Extra columns are ignored by ``keep_bitmaps`` and kept by ``apply_bitmaps``. Empty tables
give empty tables. Keys are compared by 128-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

_LINE = "h1 long, h2 long, doc long, th long, at binary"


def _lines(batches, min_chars: int):
    """(doc, th, text) -> a row for each distinct key of a document, with the positions of its lines."""
    import xxhash

    for b in slices(batches):
        h, doc, th, at = [], [], [], []
        for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if text is None or len(text) < min_chars:
                continue
            seen: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
                if len(line) < min_chars:
                    continue
                key = line.strip().lower()
                if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
                    continue
                seen.setdefault(key, []).append(i)
            for key, places in seen.items():
                h.append(xxhash.xxh3_128_digest(key))
                at.append(np.asarray(places, dtype="<u4").tobytes())
            doc += [d] * len(seen)
            th += [t] * len(seen)
        if h:
            both = np.frombuffer(b"".join(h), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(doc, pa.int64()), pa.array(th, pa.int64()), pa.array(at, pa.binary())],
                names=["h1", "h2", "doc", "th", "at"],
            )


def _stream(batches, min_docs: int):
    """Sorted rows of a partition -> lines to drop; rows of the first and the last key are passed on, to be decided over all partitions."""
    rest: list[pa.RecordBatch] = []
    first = True

    def whole(table: pa.RecordBatch, edge: bool):
        h1, h2, doc = (table.column(i).to_numpy() for i in range(3))
        if edge:
            return table.append_column("edge", pa.array(np.ones(len(h1), bool)))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new)
        docs = np.add.reduceat((new | np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64), starts)
        group = np.cumsum(new) - 1
        gone = (docs[group] >= min_docs) & (doc != doc[starts][group])
        kept = table.filter(pa.array(gone))
        return kept.append_column("edge", pa.array(np.zeros(kept.num_rows, bool)))

    for b in batches:
        if not b.num_rows:
            continue
        if rest and all(rest[-1].column(i)[-1] == b.column(i)[0] and b.column(i)[0] == b.column(i)[-1] for i in (0, 1)):
            rest.append(b)  # one key goes on
            continue
        t = pa.Table.from_batches([*rest, b]).combine_chunks().to_batches()[0]
        h1, h2 = t.column(0).to_numpy(), t.column(1).to_numpy()
        if first:  # rows of the first key
            n = int(np.argmin((h1 == h1[0]) & (h2 == h2[0]))) or len(h1)
            if n == len(h1):
                rest = [t]
                continue
            yield whole(t.slice(0, n), True)
            t, h1, h2, first = t.slice(n), h1[n:], h2[n:], False
        n = len(h1) - (int(np.argmin(((h1 == h1[-1]) & (h2 == h2[-1]))[::-1])) or len(h1))
        if n:
            yield whole(t.slice(0, n), False)
        rest = [t.slice(n)]
    if rest:
        yield whole(pa.Table.from_batches(rest).combine_chunks().to_batches()[0], True)


def _bitmaps(batches):
    for b in batches:
        n = b.column(2).to_pylist()
        gone, out = [], []
        for lines, parts in zip(n, b.column(3).to_pylist()):
            bits = np.ones(lines, bool)
            for p in parts or ():
                bits[np.frombuffer(p, "<u4")] = False
            gone.append(int(lines - bits.sum()))
            out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(gone, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "th", "n_lines", "n_dropped", "keep_bitmap"])


def _text_hash(text_col: str):
    return F.coalesce(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(0))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep_bitmap): a row for each id and text; ``th`` is the text's hash.

    ``keep_bitmap`` is a zlib-compressed bit string, a bit for each line, 1 where the line stays."""
    own = docs.select(F.col(id_col).cast("long").alias("doc"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = written(own.where(F.col("doc").isNotNull()).mapInArrow(lambda it: _lines(it, min_chars), _LINE), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    marked = written(
        lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _stream(it, min_docs), _LINE + ", edge boolean"),
        "line-drops",
    )
    edge = marked.where("edge")
    # At most two keys a partition reach its edge, so what is broadcast has two rows a partition at most.
    ids = edge.select("h1", "h2", "doc").distinct()
    most = ids.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("winner")).where(F.col("docs") >= min_docs)
    decided = edge.join(F.broadcast(most), ["h1", "h2"]).where(F.col("doc") != F.col("winner"))
    gone = marked.where(~F.col("edge")).select("doc", "th", "at").unionByName(decided.select("doc", "th", "at"))
    gone = gone.distinct().groupBy("doc", "th").agg(F.collect_list("at").alias("parts"))
    sized = own.select("doc", "th", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines")).distinct()
    joined = sized.join(gone, ["doc", "th"], "left").select("doc", "th", "n_lines", "parts")
    return joined.mapInArrow(_bitmaps, "doc_id long, th long, n_lines long, n_dropped long, keep_bitmap binary")


def _kept_text(text: str | None, bitmap: bytes | None) -> str:
    text = text or ""
    if bitmap is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return text if bits.all() else "\n".join(x for x, keep in zip(lines, bits) if keep)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with only the kept lines in the text (null: empty), and ``n_lines``, ``n_dropped``."""
    names = docs.columns
    # The row is carried as one column, so its names can't clash with those used here.
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), _text_hash(text_col).alias("__th"))
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("th").alias("__t"), F.col("n_lines").alias("__n"), F.col("n_dropped").alias("__gone"), F.col("keep_bitmap").alias("__bits"))
    joined = tagged.join(b, (F.col("__doc") == F.col("__id")) & (F.col("__th") == F.col("__t")), "left")

    @F.pandas_udf("string")
    def kept(text, bits):
        import pandas as pd

        return pd.Series([_kept_text(t, m) for t, m in zip(text, bits)], dtype=object)

    own, gone = F.col("__text"), F.coalesce(F.col("__gone"), F.lit(0))
    whole = F.size(F.split(F.coalesce(own, F.lit("")), "\n", -1)).cast("long")
    # Only documents that lose a line pass through Python.
    text = F.when(gone == 0, F.coalesce(own, F.lit(""))).otherwise(kept(F.when(gone > 0, own), F.when(gone > 0, F.col("__bits"))))
    cols = [(text if c == text_col else F.col("__row").getField(c)).alias(c) for c in names]
    return joined.select(*cols, F.coalesce("__n", whole).alias("__n_lines"), gone.cast("long").alias("__n_dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines that repeat in other documents; same columns."""
    ids = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return apply_bitmaps(docs, keep_bitmaps(docs, **options), **ids).drop("__n_lines", "__n_dropped")
