"""Exact byte-pair token counts at every prefix.

For a piece of text between two places where the tokenizer always cuts (a "pretoken"), a left-to-right dynamic program
keeps for every prefix the last token of its encoding and the number of tokens: the last token of a prefix is the one
token that ends there and that byte-pair merging leaves apart from the encoding before it. A text's table has the count of every prefix in
code points: running sums over pretokens plus the program's entries inside them, put right where the text's end would change how it is cut
(white space before a word, contractions, added tokens). Tables are stored compressed (``prefix_tables``), so how many tokens any prefix has, or where a token
budget cuts a text, is looked up and nothing is encoded again.

Defined cases. A null or empty text has 0 bytes and 0 tokens. Strings of the file's added tokens count as one token each
wherever they stand, which is the library's default. Ids are carried as they come, null ids and repeated rows included;
extra columns are ignored. Texts of any length are counted whole. A prefix longer than its text is the text. Counts can fall as a prefix grows; a budget takes
the longest prefix that keeps to it. A lone surrogate can't occur in Spark strings.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import entered, remembers

#: The pattern of byte-level pre-tokenisation.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Contractions of three characters, which their first two don't make.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Entries that a worker's memory of pretokens keeps in each of two generations.
MEMO = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts by the dynamic program; ``counts(pretoken)`` has an entry for every byte prefix, 0 first."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if all(c in letters for c in t)}
        self.rank = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = r
        self.longest = max(map(len, self.vocab))
        self.find = regex.compile(PRETOKEN).findall
        self.runs = regex.compile(r"\s{2,}(?=\S)").finditer
        added = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        #: Characters behind a pretoken that can change it: one beyond white space, or an added token that isn't whole.
        self.reach = 2 + max(map(len, added), default=0)
        self.good: set[bytes] = set()
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[bytes, tuple[bytes, bytes]] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes, stop: int = 1) -> list[bytes]:
        """Byte-pair merging itself, lowest rank first, leftmost first, down to ``stop`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens that stand at an end of ``token`` while it is built (side 1: right end), each with the rank of the merge that ends it."""
        found = self.spines[side].get(token)
        if found is None:
            found, dies, t = [(token, 1 << 60)], 1 << 60, token
            while len(t) > 1:
                pair = self.pair(t)
                dies, t = self.rank[pair], pair[side]
                found.append((t, dies))
            self.spines[side][token] = found
        return found

    def pair(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes ``token``."""
        found = self.pairs.get(token)
        if found is None:
            ways = [(token[:i], token[i:]) for i in range(1, len(token)) if (token[:i], token[i:]) in self.rank]
            found = self.pairs[token] = ways[0] if len(ways) == 1 else tuple(self.merge(token, 2))
        return found

    def stays_apart(self, left: bytes, right: bytes) -> bool:
        """Whether merging leaves ``left + right`` as these two: no merge across the seam comes before the merges that end its two sides."""
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > MEMO:
                self.apart.clear()
            found, rank = True, self.rank.get
            for a, a_dies in self.spine(left, 1):
                for b, b_dies in self.spine(right, 0):
                    r = rank((a, b))
                    if r is not None and r < a_dies and r <= b_dies:
                        found = False
            self.apart[left, right] = found
        return found

    def whole(self, token: bytes) -> bool:
        """Whether merging makes the token of its bytes; one that it doesn't make leaves the vocabulary."""
        if len(token) == 1 or self.merge(token) == [token]:
            self.good.add(token)
            return True
        self.vocab.discard(token)
        return False

    def counts(self, piece: bytes) -> list[int]:
        n, longest = len(piece), self.longest
        vocab, good, apart = self.vocab, self.good, self.apart.get
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = piece[start:end]
                if token not in vocab or token not in good and not self.whole(token):
                    continue
                if start:
                    found = apart((last[start], token))
                    if not (self.stays_apart(last[start], token) if found is None else found):
                        continue
                last[end], count[end] = token, count[start] + 1
                break
        return count

    def prefixes(self, piece: str) -> bytes | np.ndarray:
        """Tokens of every prefix of a pretoken, by characters from 1; as bytes where they fit."""
        found = self.memo.get(piece)
        if found is None:
            found = self.older.get(piece)
            if found is None:
                raw = piece.encode()
                n = self.counts(raw)[1:]
                if len(raw) > len(piece):  # an entry for each character's last byte
                    n = [k for k, after in zip(n, raw[1:] + b" ") if after & 0xC0 != 0x80]
                if piece in CONTRACTIONS:
                    n[1] = n[0] + self.prefixes(piece[1])[0]
                if max(n) > 255:
                    return np.array(n, np.int32)
                found = bytes(n)
            if len(piece) < 64:
                if len(self.memo) > MEMO:
                    self.older, self.memo = self.memo, {}
                self.memo[piece] = found
        return found

    def sections(self, text: str) -> list[str]:
        """Plain parts and, between them, added tokens."""
        return [text] if self.added is None else self.added.split(text)

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens, characters beyond which every prefix has more than ``limit`` tokens).

        A prefix has the pretokens that end ``reach`` characters before its end as the text has them, so their tokens are the least that it has."""
        n = at = 0
        upto = None
        get, more = self.memo.get, self.prefixes
        for i, part in enumerate(self.sections(text)):
            pieces = [part] if i % 2 else self.find(part)
            own = [1] if i % 2 else [(get(p) or more(p))[-1] for p in pieces]
            whole = int(sum(own))
            if upto is None and n + whole > limit:
                k = next(k for k, m in enumerate(accumulate(own, initial=n)) if m > limit)
                upto = at + sum(map(len, pieces[:k])) + self.reach
            n, at = n + whole, at + len(part)
        return n, len(text) if upto is None else min(upto, len(text))

    def cut(self, text: str, limit: int) -> int:
        """Characters of the longest prefix of at most ``limit`` tokens."""
        n, upto = self.measure(text, limit)
        return fit(self.table(text[:upto]), limit) if n > limit else len(text)

    def table(self, text: str | None) -> np.ndarray:
        """Tokens of every prefix, by characters from 0."""
        out, before, base = [np.zeros(1, np.int32)], "", 0
        for i, part in enumerate(self.sections(text or "")):
            if i % 2:
                # Inside an added token the prefix is plain text, read on from the part before.
                own = self.table(before + part[:-1])[len(before) + 1 :]
                out += [start + own, np.array([base + 1], np.int32)]
                base += 1
            else:
                start, before = base, part
                own = self._plain(part)
                out.append(base + own)
                base += int(own[-1]) if len(own) else 0
        return np.concatenate(out).astype(np.int32)

    def _plain(self, part: str) -> np.ndarray:
        pieces = [self.prefixes(p) for p in self.find(part)]
        if not pieces:
            return np.zeros(0, np.int32)
        if all(type(p) is bytes for p in pieces):
            flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32)
        else:
            flat = np.concatenate([np.frombuffer(p, np.uint8).astype(np.int32) if type(p) is bytes else p for p in pieces])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        last = flat[np.cumsum(size) - 1]
        out = flat + np.repeat(np.cumsum(last) - last, size)
        for m in self.runs(part):  # a prefix that ends behind white space has the run as one pretoken
            a, b = m.span()
            out[b - 1] = (out[a - 1] if a else 0) + self.prefixes(part[a:b])[-1]
        return out.astype(np.int32)


def fit(table: np.ndarray, budget: int) -> int:
    """The most characters whose prefix has at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1]) if budget >= 0 else 0


_counters: dict[str, PrefixCounter] = {}
remembers("token_counts", _counters.clear)


def counter(path: str) -> PrefixCounter:
    """One for each worker process and file."""
    entered("token_counts")
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) of every row; cut_chars: the longest prefix of at most ``limit`` tokens."""
    path = path or tokenizer_path()

    def run(batches):
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [c.measure(t, limit) for t in texts]
            n = np.fromiter((k for k, _ in found), np.int64, len(texts))
            size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
            # The count of a prefix depends on the prefix alone: the table of a text's head has all that can keep to the limit.
            cut = [fit(c.table(t[:upto]), limit) if k > limit else len(t) for t, (k, upto) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(cut, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_tables(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, prefix_counts binary): the counts of all prefixes, as differences (int32), compressed."""
    path = path or tokenizer_path()

    def run(batches):
        c = counter(path)
        for b in batches:
            tables = [c.table(t) for t in b.column(1).to_pylist()]
            packed = [zlib.compress(np.diff(t).astype("<i4").tobytes(), 1) for t in tables]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(t[-1]) for t in tables], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "prefix_counts"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, prefix_counts binary")


def stored_table(packed: bytes) -> np.ndarray:
    return np.r_[0, np.cumsum(np.frombuffer(zlib.decompress(packed), "<i4"))]


def tokens_at(stored: DataFrame, chars: Column) -> DataFrame:
    """``stored`` (of ``prefix_tables``) with ``n_tokens_at``: the tokens of the first ``chars`` characters, looked up."""

    @F.pandas_udf("long")
    def look(packed, n):
        return pd.Series([int(t[min(max(k, 0), len(t) - 1)]) for t, k in ((stored_table(x), int(y)) for x, y in zip(packed, n))], dtype="int64")

    return stored.withColumn("n_tokens_at", look(F.col("prefix_counts"), F.coalesce(chars, F.lit(0))))


def cut_at(stored: DataFrame, budget: Column) -> DataFrame:
    """``stored`` (of ``prefix_tables``) with ``cut_chars``: the longest prefix of at most ``budget`` tokens, looked up."""

    @F.pandas_udf("long")
    def look(packed, n):
        return pd.Series([fit(stored_table(x), int(y)) for x, y in zip(packed, n)], dtype="int64")

    return stored.withColumn("cut_chars", look(F.col("prefix_counts"), F.coalesce(budget, F.lit(0))))


def truncate_to_budget(docs: DataFrame, budget: int, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every text cut to its longest prefix of at most ``budget`` tokens (null: empty)."""
    path = path or tokenizer_path()

    @F.pandas_udf("string")
    def cut(text):
        c = counter(path)
        return text.map(lambda t: t[: c.cut(t, budget)])

    return docs.withColumn(text_col, cut(F.coalesce(F.col(text_col), F.lit(""))))
