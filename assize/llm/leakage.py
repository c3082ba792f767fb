"""Passages of held-out items inside a corpus: Wu-Manber search for all runs of ``window`` words of all items at once.

The corpus is only scanned, never shuffled: each document's words are compared with the block shift table and the buckets
of the patterns' last blocks. The tables are a few sorted arrays, about 5 bytes for a character of the items; they are built
once and read by each worker. The item set is the stated query set; where its text is larger than ``block_chars``, it is
searched for in blocks of about that size, each in one scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assize.llm.charmaps import undo

WINDOW = 12
#: Bound of the item text that is held in one task at once.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
#: Inline markup that stands for no word.
_TAG = re.compile(r"</?(?:a|abbr|b|big|blockquote|br|center|cite|code|dd|del|div|dl|dt|em|font|h[1-6]|hr|i|img|ins|kbd|li|mark|ol|p|pre|q|s|samp|small|span|strike|strong|sub|sup|table|tbody|td|th|tr|tt|u|ul|var)(?:\s[^<>]*)?/?>", re.I)


def normal_words(text: str) -> list[str]:
    """Words as they are compared: deviating characters undone, markup and punctuation dropped, lower case."""
    t = undo(text)
    return _WORD.findall((_TAG.sub(" ", t) if "<" in t else t).lower())


class _Numbers(dict):
    """Word -> its place in the sorted hashes of the items' words, -1 if it is none of them; frequent words are kept."""

    def __init__(self, known: np.ndarray):
        super().__init__()
        self.known = known

    @staticmethod
    def hash(w: str) -> int:
        return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest())

    def learn(self, words: set[str]) -> None:
        """Looks all of these words up that aren't kept yet, at once."""
        if len(self) > 1 << 19:
            self.clear()
        new = list(words - self.keys())
        if new:
            h = np.array([self.hash(w) for w in new], np.uint64)
            at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
            self.update(zip(new, np.where(self.known[at] == h, at, -1).tolist() if len(self.known) else [-1] * len(new)))


class WuManber:
    """All runs of ``window`` words of the items, as patterns of one length over numbered words; a block is two words.

    ``words`` has the numbered words of all items after one another; a pattern is a place in it. ``blocks`` and ``shift`` are
    the shift table; patterns are sorted by their last block and, within such a bucket, by a hash of the whole.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        if window < 2:
            raise ValueError("a block needs two words")
        self.window = window
        hashes: dict[str, int] = {}
        texts = [(i, np.array([h if (h := hashes.get(w)) is not None else hashes.setdefault(w, _Numbers.hash(w)) for w in normal_words(t or "")], np.uint64)) for i, t in items]
        size = np.array([len(t) for _, t in texts], np.int64)
        flat = np.concatenate([t for _, t in texts]) if size.sum() else np.empty(0, np.uint64)
        self.known, words = np.unique(flat, return_inverse=True)
        self.words = words.astype(np.int32)
        self.item = np.repeat(np.array([i for i, _ in texts], np.int64), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))
        starts = np.nonzero(left >= window)[0].astype(np.int64)
        self.base = np.int64(len(self.known) + 1)
        blocks = self.words[:-1].astype(np.int64) * self.base + self.words[1:]
        # how far each block's end stands before the end of a pattern that holds it, the least of all; blocks of no pattern let all but one word pass
        shift = np.full(len(blocks), window - 1, np.int64)
        if len(starts):
            for j in range(window - 1):
                np.minimum.at(shift, starts + j, window - 2 - j)
        order = np.argsort(blocks, kind="stable")
        self.blocks, first = np.unique(blocks[order], return_index=True)
        self.shift = (np.minimum.reduceat(shift[order], first) if len(first) else np.empty(0)).astype(np.int16)
        h = np.zeros(len(starts), np.uint64)
        for j in range(window):
            h = (h ^ flat[starts + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        last = blocks[starts + window - 2] if len(starts) else np.empty(0, np.int64)
        order = np.lexsort((h, last))
        self.starts, self.hashed = starts[order].astype(np.int32), h[order]
        self.bucket = last[order]
        self.numbers: _Numbers | None = None

    def search(self, text: str) -> set[int]:
        return self.search_all([text])[0]

    def search_all(self, texts: list[str]) -> list[set[int]]:
        """The items of each text."""
        if self.numbers is None:
            self.numbers = _Numbers(self.known)
        words = [normal_words(t) for t in texts]
        self.numbers.learn(set().union(*words))
        return [self._search(np.array([self.numbers[w] for w in ws], np.int64)) for ws in words]

    def _search(self, ids: np.ndarray) -> set[int]:
        m, n, found = self.window, len(ids), set()
        if not len(self.starts) or bytes([1]) * m not in (ids >= 0).tobytes():  # never so many of the items' words in a row
            return found
        blocks = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.base + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.blocks, blocks), len(self.blocks) - 1)
        step = np.where(self.blocks[at] == blocks, self.shift[at], m - 1)
        step = np.where(ids[1:] < 0, m, step).tolist()  # a word of no item: no run holds it
        pos = m - 1
        while pos < n:
            if step[pos - 1]:
                pos += step[pos - 1]
                continue
            found |= self._owners(ids[pos - m + 1 : pos + 1])
            pos += 1
        return found

    def _owners(self, window: np.ndarray) -> set[int]:
        """Items with a pattern in the bucket of the window's last block that is the window, word by word."""
        if window.min() < 0:
            return set()
        block = window[-2] * self.base + window[-1]
        a, b = np.searchsorted(self.bucket, block), np.searchsorted(self.bucket, block, side="right")
        h = np.zeros(1, np.uint64)
        for w in self.known[window]:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        a, b = a + np.searchsorted(self.hashed[a:b], h[0]), a + np.searchsorted(self.hashed[a:b], h[0], side="right")
        at = self.starts[a:b].astype(np.int64)
        same = (self.words[at[:, None] + np.arange(self.window)] == window).all(1)
        return set(self.item[at[same]].tolist())


def leaked_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Distinct pairs (doc_id, item_id) where ``window`` consecutive words of the item stand in the document.

    ``documents`` (doc_id, text) and ``items`` (item_id, text) may have any further columns. Null and empty texts, and
    items of fewer than ``window`` words, match nothing; repeated rows count once; empty tables give no rows; long texts
    are searched whole.
    """
    chars = items.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    query = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    out = None
    for k in range(blocks):
        part = query.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else query
        held = documents.sparkSession.sparkContext.broadcast(WuManber([(r.item_id, r.text) for r in part.collect()], window))

        def scan(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            engine = held.value
            for b in batches:
                hits = [(d, i) for d, found in zip(b["doc_id"], engine.search_all(b["text"].tolist())) for i in found]
                if hits:
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id"])

        got = docs.mapInPandas(scan, "doc_id bigint, item_id bigint")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def leak_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents it leaked into (item_id, benchmark, n_docs); 0 where it leaked into none."""
    n = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "benchmark").join(n, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("bigint")))
