"""Packing into fixed windows by non-negative least squares over length combinations.

Documents are encoded once. A document's full windows are sequences of their own; what is left of each is a piece of
1 to window - 1 tokens. The histogram of those lengths (at most window - 1 bins, whatever the corpus) goes to the
driver, which enumerates combinations of two to four lengths that fill a window exactly, solves for their repeat
counts by non-negative least squares, rounds them down to what the histogram holds, and packs the residual pieces
greedily: exact fills first, then next-fit, cutting the piece that crosses a window's end. The last window's pieces are cut at
powers of two, so no sequence needs padding.

The plan says, for each length, which ranks go where; a piece's rank among those of its length comes from per-task
counts and a running sum, so no length, however common, meets in one task.

Nulls: a null text is empty: such a document is its closing token alone. Repeated rows are packed each. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, ragged, slices, text_column, written


#: A worker's table of words holds about so many (20 bytes each besides their ids) before it starts anew.
MOST_WORDS = 1 << 20
#: Texts that are encoded together hold about so many bytes.
TOGETHER = 2 << 20


#: A word of letters that the normalizer leaves as they are, and the ASCII marks behind it: the pre-tokenizer parts the two.
_PLAIN = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


@lru_cache(maxsize=1)
def tokenizers_of(path: str) -> tuple:
    """The encoder, one for words of letters only, and which of its ids end a word (those whose strings end in ``</w>``)."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole, letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
    letters.normalizer = normalizers.Sequence([])
    letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(whole.get_vocab_size(), bool)
    ends[[i for token, i in whole.get_vocab().items() if token.endswith("</w>")]] = True
    return whole, letters, ends


class WordEncoder:
    """Encodes by white-space separated words, each looked up by its 64-bit hash in a sorted table of words seen.

    The encoder's pre-tokenizer never joins what white space separates, so a text's ids are those of its words. Words
    not in the table are encoded together, letters apart from the marks behind them.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.encoder, self.letters, self.ends = tokenizers_of(path)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        """Only the empty word is known, which has no ids."""
        self.keys, self.starts, self.lengths = np.array([hash("")], np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.flat = np.zeros(0, np.uint32)

    @staticmethod
    def prepared(text: str) -> str:
        """Words apart by single characters; lower-cased (fewer words to know) where the normalizer's order (NFC, then lower case) makes no difference."""
        low = text.lower()
        if text.isascii() and "<|" not in text or not ("Σ" in text or "<|" in text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
            text = low
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        e = self.encoder.encode(" ".join(words), add_special_tokens=False)
        at = np.cumsum([0, *(len(w) + 1 for w in words)][:-1])
        first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
        return np.array(e.ids, np.uint32), np.bincount(np.searchsorted(at, first, "right") - 1, minlength=len(words))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.letters.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words are in the table, and whether they are there."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def _insert(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.starts = np.insert(self.starts, at, (len(self.flat) + np.cumsum(n) - n)[order])
        self.lengths = np.insert(self.lengths, at, n[order])
        self.flat = np.concatenate([self.flat, ids])

    def _add(self, words: list[str], encode) -> np.ndarray:
        """Adds those not yet known; the hashes of all."""
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        new, first = np.unique(hashes, return_index=True)
        first = first[~self._find(new)[1]]
        if len(first):
            self._insert(hashes[first], *encode([words[i] for i in first.tolist()]))
        return hashes

    def _learn(self, hashes: np.ndarray, words: pa.Array) -> None:
        missing = ~self._find(hashes)[1]
        if len(self.keys) + 2 * int(missing.sum()) > self.most:
            self._forget()
            missing = ~self._find(hashes)[1]
        if not missing.any():
            return
        parts = [m.groups() if (m := _PLAIN.fullmatch(w)) else ("", w) for w in words.filter(pa.array(missing)).to_pylist()]
        letters = self._add([p[0] for p in parts], self._encode_letters)
        rest = self._add([p[1] for p in parts], self._encode)
        joined = np.flatnonzero(~self._find(hashes[missing])[1])
        both = np.stack([self._find(letters[joined])[0], self._find(rest[joined])[0]], 1).ravel()
        self._insert(hashes[missing][joined], self.flat[ragged(self.starts[both], self.lengths[both])], self.lengths[both].reshape(-1, 2).sum(1))

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        split = pc.split_pattern(pa.array(map(self.prepared, texts), pa.string()), " ")
        words = split.flatten().dictionary_encode()
        hashes = np.fromiter(map(hash, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        order = np.argsort(hashes)  # a sorted search is a fast one
        self._learn(hashes[order], words.dictionary.take(pa.array(order)))
        place = np.empty(len(order), np.int64)
        place[order] = self._find(hashes[order])[0]
        index = place[words.indices.to_numpy()]
        n = self.lengths[index]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return self.flat[ragged(self.starts[index], n)], np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])


@lru_cache(maxsize=1)
def word_encoder(path: str, stage: int) -> WordEncoder:
    """A worker's encoder: tasks of one stage share its table of words, the next stage starts with none."""
    return WordEncoder(path)


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, common: int = 48) -> list[tuple[int, ...]]:
    """Shallow combinations that fill a window: every pair, and triples and fours through the most common lengths."""
    have = set(lengths.tolist())
    out = {(a, window - a) for a in have if a <= window - a and window - a in have}
    top = lengths[np.argsort(-counts, kind="stable")][:common].tolist()
    ordered = sorted(have)
    for i, a in enumerate(top):
        for b in ordered:
            if (c := window - a - b) in have:
                out.add(tuple(sorted((a, b, c))))
        for b in top[i:]:
            for c in top[: common // 4]:
                if (d := window - a - b - c) in have:
                    out.add(tuple(sorted((a, b, c, d))))
    return sorted(out)


def nnls(columns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' use of each length near its count, by accelerated projected gradients."""
    slot = np.searchsorted(lengths, np.array([v for c in columns for v in c]))
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    weight = 1 / np.sqrt(np.maximum(counts, 1))  # so that rare lengths count too
    forward = lambda x: np.bincount(slot, x[col], len(lengths)) * weight
    back = lambda y: np.bincount(col, (y * weight)[slot], len(columns))
    step = np.ones(len(columns))
    for _ in range(20):  # the largest eigenvalue, by powers
        step = back(forward(step))
        scale = np.linalg.norm(step)
        step /= max(scale, 1e-30)
    target = counts * weight
    x = z = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - back(forward(z) - target) / (1.05 * scale))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, x = new + (old - 1) / t * (new - x), new
    return x


def make_plan(histogram: dict[int, int], window: int) -> tuple[dict[int, list[tuple]], int]:
    """For each length, runs (first rank, ranks, kind, ...): ``slots`` (first sequence, offsets) or ``line`` (position)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: dict[int, list[tuple]] = {n: [] for n in left}
    sequences = 0

    def commit(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at, offsets = 0, {}
        for n in combo:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            runs[n].append((used[n], times * len(where), "slots", sequences, tuple(where)))
            used[n] += times * len(where)
            left[n] -= times * len(where)
        sequences += times

    lengths = np.array(sorted(left), np.int64)
    columns = combinations(lengths, np.array([left[n] for n in lengths.tolist()]), window) if len(lengths) else []
    if columns:
        x = nnls(columns, lengths, np.array([left[n] for n in lengths.tolist()], float))
        for i in np.argsort(-x, kind="stable").tolist():
            need = {n: columns[i].count(n) for n in columns[i]}
            times = min(int(x[i] + 0.5), *(left[n] // k for n, k in need.items()))
            if times > 0:
                commit(columns[i], times)
    order = sorted(n for n, c in left.items() if c > 0)
    for n in order[::-1]:  # exact fills, the largest piece first
        while left[n] > 0:
            combo, room, spare = [n], window - n, dict(left)
            spare[n] -= 1
            i = bisect.bisect_right(order, room)
            while room and i:
                i -= 1
                while spare[order[i]] > 0 and order[i] <= room:
                    combo.append(order[i])
                    spare[order[i]] -= 1
                    room -= order[i]
                i = min(i, bisect.bisect_right(order, room))
            if room:
                break
            commit(tuple(combo), min(left[k] // combo.count(k) for k in set(combo)))
    position = 0
    for n in order[::-1]:
        if left[n] > 0:
            runs[n].append((used[n], left[n], "line", sequences, position))
            position += n * left[n]
    return runs, position


def cuts(position: int, length: int, total: int, window: int, first: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start, length, sequence, offset) of an item on the line of residuals."""
    full = total // window * window
    out, at, end = [], position, position + length
    while at < end:
        if at < full:
            sequence, offset = divmod(at, window)
            room = window - offset
        else:  # the last window is cut at the powers of two that add up to it
            base, sequence, rest = full, total // window, total - full
            while at >= base + (1 << rest.bit_length() - 1):
                base += 1 << rest.bit_length() - 1
                rest -= 1 << rest.bit_length() - 1
                sequence += 1
            offset = at - base
            room = (1 << rest.bit_length() - 1) - offset
        n = min(room, end - at)
        out.append((at - position, n, first + sequence, offset))
        at += n
    return out


FIRST = "doc_id long, doc_tokens long, start long, length int, crc long, ids binary, part int, rank long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece: PACKED. Sequences are numbered from 0 without gaps."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder = word_encoder(tokenizer_path, context.stageId())
        part, ranks = context.partitionId(), np.zeros(window, np.int64)
        names = [x.split()[0] for x in FIRST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for b in batches:
            rows: list[tuple] = []
            for some in slices(b, size=TOGETHER):
                ids, n = encoder.encode_batch(some["text"].to_pylist())
                end = 0
                for doc_id, k in zip(some["doc_id"].to_pylist(), n.tolist(), strict=True):
                    own = np.append(ids[end : end + k], np.uint32(end_id)).astype("<u4")
                    end += k
                    total = k + 1
                    for start in range(0, total, window):
                        piece = own[start : start + window]
                        key = len(piece) % window  # full windows are counted at 0
                        rows.append((doc_id, total, start, len(piece), zlib.crc32(piece.tobytes()), piece.astype("<u2" if piece.max() < 65536 else "<u4").tobytes() if key else None, part, int(ranks[key])))
                        ranks[key] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, types, strict=True)], names=names)

    pieces = written(text_column(docs).mapInArrow(frugal(encode), FIRST), "pieces")
    key = (F.col("length") % window).alias("key")
    counts = written(pieces.groupBy("part", key).agg(F.count("*").alias("n")), "counts")
    histogram = {r["key"]: r["n"] for r in counts.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = histogram.pop(0, 0)
    runs, total = make_plan(histogram, window)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "key", before.alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {n: [r[0] for r in rs] for n, rs in runs.items()}
        for b in batches:
            rows: list[tuple] = []
            for doc_id, doc_tokens, start, n, crc, raw, rank in zip(*(b[c].to_pylist() for c in ("doc_id", "doc_tokens", "start", "length", "crc", "ids", "rank")), strict=True):
                if n == window:
                    rows.append((doc_id, start, n, crc, doc_tokens, rank, 0))
                    continue
                base, _, kind, sequence, where = runs[n][bisect.bisect_right(starts[n], rank) - 1]
                if kind == "slots":
                    times, slot = divmod(rank - base, len(where))
                    rows.append((doc_id, start, n, crc, doc_tokens, full + sequence + times, where[slot]))
                    continue
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for s, k, seq, offset in cuts(where + (rank - base) * n, n, total, window, full + sequence):
                    rows.append((doc_id, start + s, k, zlib.crc32(ids[s : s + k].tobytes()), doc_tokens, seq, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=[x.split()[0] for x in PACKED.split(", ")])

    ranked = pieces.withColumn("key", key).join(offsets, ["part", "key"], "left")
    placed = ranked.select("doc_id", "doc_tokens", "start", "length", "crc", "ids", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("rank"))
    return placed.mapInArrow(frugal(place), PACKED)
