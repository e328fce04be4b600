"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with white space collapsed. A test item of m characters may differ by k edits, where
k + 1 pieces of at least ``piece`` characters fit into m: whatever the k edits hit, one piece stays whole. All pieces
of all items are found in one pass over each document, a q-gram count discards most chance hits, and Myers'
bit-parallel distance decides.

Items are taken in blocks of bounded size, so a large benchmark means more passes, never a larger broadcast. Documents
are scanned where they are read; nothing is shuffled. Nulls: a null text is empty, an empty item matches nothing, an
item shorter than two pieces must occur exactly. Repeated rows are scanned apart. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

Q = 5
HITS = "doc_id long, item_id long, distance int, start long, end long, n_hits int"
_WORD = re.compile(r"\S+")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


class Item:
    """A test item: its error budget, its pieces and its match masks."""

    __slots__ = ("item_id", "text", "budget", "pieces", "masks", "back", "grams", "needed")

    def __init__(self, item_id: int, text: str, piece: int):
        self.item_id, self.text, m = item_id, text, len(text)
        self.budget = max(m // piece, 1) - 1
        edges = [m * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.masks, self.back = masks_of(text), masks_of(text[::-1])
        self.grams = {text[i : i + Q] for i in range(m - Q + 1)}
        self.needed = len(self.grams) - self.budget * Q


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern to a substring of ``text`` that ends at the returned position (the first such).

    ``anchored``: the substring starts at 0. One machine word per pattern, of any width.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = ((((eq & plus) + plus) ^ plus) | eq) & full
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def find_items(text: str, automaton, items: list[Item]) -> dict[int, list[tuple[int, int, int]]]:
    """(distance, start, end) of each item's matches in a normalised text; matches of an item do not overlap."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    tried: set[tuple[int, int]] = set()
    for last, where in automaton.iter(text):
        for i, offset, size in where:
            item = items[i]
            start = last - size + 1 - offset
            if (i, start) in tried or (i in found and start < found[i][-1][2] and found[i][-1][1] - item.budget <= start):
                continue
            tried.add((i, start))
            m, k = len(item.text), item.budget
            if start >= 0 and text.startswith(item.text, start):
                found.setdefault(i, []).append((0, start, start + m))
                continue
            if not k:
                continue
            base = max(0, start - k)
            window = text[base : start + m + k]
            if len({window[j : j + Q] for j in range(len(window) - Q + 1)} & item.grams) < item.needed:
                continue
            distance, end = myers(item.masks, m, window)
            if distance <= k:
                _, length = myers(item.back, m, window[:end][::-1], anchored=True)
                found.setdefault(i, []).append((distance, base + end - length, base + end))
    return found


def raw_span(raw: str, start: int, end: int) -> tuple[int, int]:
    """The span of whole words in the raw text that holds a span of its normalised form."""
    at, first, last = 0, 0, len(raw)
    for m in _WORD.finditer(raw):
        if at <= start:
            first = m.start()
        if at < end:
            last = m.end()
        at += len(m[0].lower()) + 1
    return first, last


def _scan(docs: DataFrame, block: list[tuple[int, str]], piece: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not block:
            return
        items = [Item(i, t, piece) for i, t in block]
        by: dict[str, list[tuple[int, int, int]]] = {}
        for n, item in enumerate(items):
            for offset, p in item.pieces:
                by.setdefault(p, []).append((n, offset, len(p)))
        automaton = ahocorasick.Automaton()
        for p, where in by.items():
            automaton.add_word(p, where)
        automaton.make_automaton()
        names = [x.split()[0] for x in HITS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                for i, hits in find_items(normalise(raw), automaton, items).items():
                    distance, start, end = min(hits)
                    rows.append((doc_id, items[i].item_id, distance, *raw_span(raw, start, end), len(hits)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    return text_column(docs).mapInArrow(run, HITS)


def find_leaks(docs: DataFrame, benchmark: DataFrame, piece: int = 24, block_chars: int = 1 << 20) -> DataFrame:
    """One row per contaminated (document, item): the least distance, where it is in the raw text, and how many matches."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    blocks = []
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # about block_chars characters
        texts = sorted({(r["item_id"], t) for r in rows if (t := normalise(r["text"]))}, key=lambda x: (x[0] is not None, x))
        blocks.append(_scan(docs, texts, piece))
    return reduce(DataFrame.unionByName, blocks)
