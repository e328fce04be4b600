"""Removal of long repeated substrings with a blockwise suffix array over a difference cover.

Every byte that a string of ``depth`` bytes covers goes, if that string also starts in a document with a smaller
doc_id. Suffixes need sorting by their first ``depth`` bytes only, and only where a repeat is possible:

1. Each document is sampled by local minima of a rolling hash over ``GRAM`` bytes. Every string of ``depth`` bytes has
   one sample, the leftmost least of its hashes, and has the same one wherever it occurs. A run of strings with one
   sample spans a context. Samples travel to the suffix bucket of their hash, as packed hashes of sample and context.
   A bucket drops samples that one document alone holds. Where all contexts of a sample tie over their whole length,
   they share one rank: all but those of the smallest document are covered.
2. The other contexts travel to their bucket with the bytes that they span. A bucket is sorted at a time: equal contexts
   are ranked once; of the rest, suffixes are sorted by their first bytes, and ties are resolved by precomputed ranks of
   a difference cover's sample positions, counted from the sample, so that equal strings have equal residues.
3. Covered stretches return to their documents, are merged and cut out.

Texts are shuffled once, by doc_id, and that exchange is reused in every step. The number of buckets grows with the
bytes of the input, and a task holds one bucket at a time; what one sample has in common is in one bucket, however many
documents hold it. Samples are known by 40 bits besides their bucket's, contexts by 64 more; where these decide alone,
they do so together.

Nulls: a null text is empty, and texts of any length (up to Spark's 2 GB) are read whole; a document with a null doc_id is returned whole and removes nothing. Rows with the same
doc_id do not remove each other's bytes. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_out, mix64, ragged, text_column

GRAM = 22
#: A difference cover: every residue reaches one of these in at most 5 steps, modulo 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
STEP = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])
#: Texts that are hashed together hold about so many bytes.
CHUNK = 1 << 21
#: Low bits of a packed minimum hold its position in the chunk, which is one text of up to 2 GB at most; of equal upper bits the leftmost counts.
PLACE = 32
#: Buckets for each task of a bucket shuffle.
SPLIT = 4
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position, by doubling."""
    base = 0xD1342543DE82EF95
    h = {1: _BYTES[data]}
    powers = {1 << i: np.uint64(pow(base, 1 << i, 1 << 64)) for i in range(GRAM.bit_length())}
    length = 1
    while 2 * length <= GRAM:
        x = h[length]
        h[2 * length] = x[:-length] * powers[length] + x[length:] if len(x) > length else x[:0]
        length *= 2
    n = max(len(data) - GRAM + 1, 0)
    out, at = np.zeros(n, np.uint64), 0
    for length in sorted(h, reverse=True):
        if GRAM - at >= length:
            out = out * powers[length] + h[length][at : at + n]
            at += length
    return mix64(out)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every window of ``width`` elements, by doubling."""
    length = 1
    while 2 * length <= width:
        x = op(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def chunks(sizes: list[int]) -> Iterator[slice]:
    at = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= CHUNK:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


class Sampled:
    """Some texts of at least ``depth`` bytes, one after another, and the runs of their strings with one sample.

    ``first``, ``count``, ``at``: a run's first string, its strings and its sample, as positions in ``data``.
    """

    def __init__(self, texts: list[bytes], depth: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.depth = depth
        hashes = gram_hashes(self.data)
        low = np.uint64((1 << PLACE) - 1)
        packed = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
        where = (sliding(packed, depth - GRAM + 1, np.minimum) & low).astype(np.int64)
        for end in (self.starts + self.sizes)[:-1].tolist():
            where[end - depth + 1 : end] = -1  # strings that lie in two texts
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        count = np.diff(np.append(first, len(where)))
        keep = where[first] >= 0
        self.first, self.count, self.at = first[keep], count[keep], where[first][keep]
        self.text = np.searchsorted(self.starts, self.first, "right") - 1
        self.hash = hashes[self.at]

    def contexts(self) -> np.ndarray:
        """A 64-bit hash of each run's bytes and shape."""
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.data] * _powers(len(self.data)), dtype=np.uint64)])
        end = self.first + self.count + self.depth - 1
        whole = (prefix[end] - prefix[self.first]) * _inverse(self.first)
        return mix64(whole + (self.at - self.first).astype(np.uint64) + (self.count.astype(np.uint64) << np.uint64(8)))

    def among(self, own: list[bytes], buckets: int) -> np.ndarray:
        """Which runs have a sample that their text's entry of ``own`` lists (see ``marked``)."""
        hit = np.zeros(len(self.hash), bool)
        marks = marked(self.hash >> np.uint64(24), bucket_of(self.hash, buckets))
        edges = np.searchsorted(self.text, np.arange(len(self.sizes) + 1)).tolist()
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if own[i] and a < b:
                hit[a:b] = np.isin(marks[a:b], np.frombuffer(own[i], np.uint64))
        return hit


def short(h: np.ndarray) -> np.ndarray:
    """The upper 40 bits of hashes, as rows of 5 bytes."""
    return np.ascontiguousarray((h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def long(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def marked(upper: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """Samples by the upper 40 bits of their hashes and their buckets."""
    return upper << np.uint64(24) | np.asarray(bucket).astype(np.uint64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h & np.uint64(0xFFFFFF)) % np.uint64(n)


def packed_rows(bucket: np.ndarray, columns: list[np.ndarray], blobs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """A row for each bucket, with its part of each column as bytes; ``blobs`` are (data, starts, lengths)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    parts = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    out = [pa.array(bucket[edges[:-1]].astype(np.int32), pa.int32())]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[i:j].tobytes() for i, j in parts], pa.binary()))
    if blobs:
        data, starts, lengths = blobs[0], blobs[1][order], blobs[2][order]
        out.append(pa.array([data[ragged(starts[i:j], lengths[i:j])].tobytes() for i, j in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *(f"c{i}" for i in range(len(out) - 1))])


def by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[bytes]]]:
    """A bucket and its columns, joined, one at a time; rows come sorted by bucket."""
    current, held = None, []
    for b in batches:
        for bucket, *rest in zip(*(b[i].to_pylist() for i in range(columns + 1)), strict=True):
            if bucket != current and held:
                yield current, [b"".join(x) for x in zip(*held, strict=True)]
                held = []
            current = bucket
            held.append(rest)
    if held:
        yield current, [b"".join(x) for x in zip(*held, strict=True)]


def by_document(doc: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each document, with its part of each column as bytes."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    edges = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)) if len(doc) else np.zeros(1, np.int64)
    parts = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    out = [pa.array(doc[edges[:-1]], pa.int64())]
    for c in columns:
        c = c[order]
        out.append(pa.array([c[i:j].tobytes() for i, j in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=["doc_id", *(f"c{i}" for i in range(len(columns)))])


def group_minima(order: np.ndarray, new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each element, the least of ``values`` in its group; ``new`` marks the groups' first elements in ``order``."""
    out = np.empty(len(order), values.dtype)
    if len(order):
        least = np.minimum.reduceat(values[order], np.flatnonzero(new))
        out[order] = least[np.cumsum(new) - 1]
    return out


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position, as an integer that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | data[at + i]
    return out


def sort_bucket(data: np.ndarray, suffixes: np.ndarray, offset: np.ndarray, block: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the suffixes of a bucket by block, then by their first ``depth`` bytes.

    ``offset`` is a suffix's distance to its block's sample position; suffixes with different ones never tie. Returns
    the order, and whether each suffix in it differs from the one before. A suffix is compared by its first 8 bytes;
    then by the rank of the sampled position that its residue leads to, at most 5 bytes on, ranked beforehand on its
    first ``span`` bytes; then by its last 16 bytes. Together these are all of its bytes.
    """
    span = depth - 16 + 1
    step = STEP[offset % MODULUS]
    place, back = np.unique(suffixes + step, return_inverse=True)
    keys = [words_at(data, place + i) for i in [*range(0, span - 7, 8), span - 8]]
    order = np.lexsort(keys[::-1])
    differs = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) else np.zeros(0, bool)
    rank = np.empty(len(place), np.int64)
    rank[order] = np.cumsum(differs)
    tails = [words_at(data, suffixes + depth - 8), words_at(data, suffixes + depth - 16)]
    columns = [block, offset, words_at(data, suffixes), rank[back], *tails]
    order = np.lexsort(columns[::-1])
    return order, np.append(True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)) if len(order) else np.zeros(0, bool)


def repeats(doc: np.ndarray, anchor: np.ndarray, offset: np.ndarray, windows: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """For each window of each context of a bucket, whether a smaller document has the same string.

    A context is ``windows`` suffixes in a row, whose first lies ``offset`` bytes before the sample; ``anchor`` is the
    sample's hash.
    """
    lengths = windows + depth - 1
    starts = np.cumsum(lengths) - lengths
    # long ties first: contexts that are equal over their whole length are one
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _powers(len(data)), dtype=np.uint64)])
    whole = (prefix[starts + lengths] - prefix[starts]) * _inverse(starts)
    order = np.lexsort((doc, whole, windows, offset, anchor))
    same = [x[order] for x in (whole, windows, offset, anchor)]
    new = np.append(True, np.any([x[1:] != x[:-1] for x in same], axis=0)) if len(order) else np.zeros(0, bool)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    keeper = order[new]  # each kind's context in its smallest document
    n = windows[keeper]
    suffixes, owner = ragged(starts[keeper], n), np.repeat(np.arange(len(keeper)), n)
    distance = np.repeat(offset[keeper], n) - (suffixes - np.repeat(starts[keeper], n))
    block = np.unique(anchor[keeper], return_inverse=True)[1]
    alone = np.bincount(block)[block] == 1  # a sample with one kind of context has nothing left to sort
    least = np.repeat(doc[keeper], n)
    open_ = np.flatnonzero(~alone[owner])
    if len(open_):
        order, new = sort_bucket(data, suffixes[open_], distance[open_], block[owner[open_]], depth)
        least[open_] = group_minima(order, new, least[open_])
    first = np.cumsum(n) - n
    return least[ragged(first[kind], windows)] < np.repeat(doc, windows)


_MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)
_MULTIPLIER_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _MULTIPLIER)]), dtype=np.uint64)[:n]


def _inverse(at: np.ndarray) -> np.ndarray:
    n = int(at.max()) + 1 if len(at) else 0
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _MULTIPLIER_INVERSE)]), dtype=np.uint64)[at] if n else at.astype(np.uint64)


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that sorted (start, end) rows cover."""
    out: list[tuple[int, int]] = []
    for a, b in spans.tolist():
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_repeats(docs: DataFrame, depth: int = 50) -> DataFrame:
    """doc_id, text as bytes, and the covered stretches of every document (packed)."""
    if depth < GRAM + 8:
        raise ValueError(f"depth is at least {GRAM + 8}")
    if depth > GRAM + 254:
        raise ValueError(f"depth is at most {GRAM + 254}")
    texts = text_column(docs).filter("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    n = dealt_out(texts)
    texts, buckets = texts.repartition(n, "doc_id"), SPLIT * n

    def usable(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Sampled, list[int]]]:
        data = b["text"].to_pylist()
        keep = [i for i, t in enumerate(data) if len(t) >= depth]
        ids = np.array(b["doc_id"].to_pylist(), object)[keep].astype(np.int64)
        for part in chunks([len(data[i]) for i in keep]):
            yield ids[part], Sampled([data[i] for i in keep[part]], depth), keep[part]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, s, _ in usable(b):
                c = s.contexts()
                order = np.lexsort((c, s.hash, s.text))
                text, h, c = s.text[order], s.hash[order], c[order]
                new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
                text, h, c = text[new], h[new], c[new]
                yield packed_rows(bucket_of(h, buckets), [ids[text], short(h), c])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, raw in by_bucket(batches, 3):
            doc, h, c = np.frombuffer(raw[0], np.int64), long(raw[1]), np.frombuffer(raw[2], np.uint64)
            order = np.lexsort((doc, h))
            doc, h, c = doc[order], h[order], c[order]
            new = np.append(True, h[1:] != h[:-1])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            last = np.append(first[1:] - 1, len(h) - 1)
            tied = np.minimum.reduceat(c, first) == np.maximum.reduceat(c, first)
            once = new | np.append(True, doc[1:] != doc[:-1])  # a document's sample with several contexts is one
            several = (doc[first] != doc[last])[group] & once
            closed = several & tied[group] & (doc > doc[first][group])
            open_ = several & ~tied[group]
            for at, empty in ((closed, 1), (open_, 0)):
                part = by_document(doc[at], [marked(h[at], bucket)])
                nothing = pa.array([None] * part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([part[0], *((part[1], nothing) if empty else (nothing, part[1]))], names=["doc_id", "closed", "open"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            closed, open_ = b["closed"].to_pylist(), b["open"].to_pylist()
            for ids, s, rows in usable(b):
                tied = s.among([b"".join(closed[row]) for row in rows], buckets)
                text, start = s.text[tied], (s.first - s.starts[s.text])[tied]
                end = start + s.count[tied] + depth - 1
                if len(text):  # known to be covered: stretches that meet are one, and pass through under a bucket below 0
                    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] > end[:-1]))
                    last = np.append(np.flatnonzero(new)[1:] - 1, len(text) - 1)
                    done = [ids[text[new]].tobytes(), b"", start[new].astype(np.uint32).tobytes(), end[last].astype(np.uint32).tobytes(), b"", b""]
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - int(ids[0]) % n], pa.int32()), *(pa.array([x], pa.binary()) for x in done)], names=["bucket", *(f"c{i}" for i in range(6))])
                hit = s.among([b"".join(open_[row]) for row in rows], buckets)
                first, count, at, text, h = s.first[hit], s.count[hit], s.at[hit], s.text[hit], s.hash[hit]
                yield packed_rows(bucket_of(h, buckets), [ids[text], h, (first - s.starts[text]).astype(np.uint32), (at - first).astype(np.uint8), count.astype(np.uint8)], (s.data, first, count + depth - 1))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, raw in by_bucket(batches, 6):
            if bucket < 0:
                yield by_document(np.frombuffer(raw[0], np.int64), [np.frombuffer(raw[2], np.uint32), np.frombuffer(raw[3], np.uint32)])
                continue
            doc, h, at, offset, count, data = (np.frombuffer(x, d) for x, d in zip(raw, (np.int64, np.uint64, np.uint32, np.uint8, np.uint8, np.uint8), strict=True))
            at, offset, count = at.astype(np.int64), offset.astype(np.int64), count.astype(np.int64)
            edges = [0]  # whole samples, so many that their suffixes fit in memory
            order = np.argsort(h, kind="stable")
            starts = np.cumsum(count + depth - 1) - (count + depth - 1)
            load = np.cumsum((count + depth - 1)[order])
            while edges[-1] < len(h):
                end = int(np.searchsorted(load, (load[edges[-1] - 1] if edges[-1] else 0) + (1 << 23)))
                end = min(max(end, edges[-1] + 1), len(h))
                edges.append(int(np.searchsorted(h[order], h[order[end - 1]], "right")))
            for i, j in zip(edges, edges[1:], strict=False):
                part = order[i:j]
                bit = repeats(doc[part], h[part], offset[part], count[part], data[ragged(starts[part], count[part] + depth - 1)], depth)
                place, owner = ragged(at[part], count[part])[bit], np.repeat(doc[part], count[part])[bit]
                if len(place):
                    order2 = np.lexsort((place, owner))
                    place, owner = place[order2], owner[order2]
                    new = np.append(True, (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + 1))
                    last = np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)
                    yield by_document(owner[new], [place[new].astype(np.uint32), (place[last] + depth).astype(np.uint32)])

    sampled = texts.mapInArrow(sample, "bucket int, c0 binary, c1 binary, c2 binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    known = sampled.mapInArrow(shared, "doc_id long, closed binary, open binary").groupBy("doc_id").agg(F.collect_list("closed").alias("closed"), F.collect_list("open").alias("open"))
    hopeful = texts.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "closed", "open")
    schema = "bucket int, " + ", ".join(f"c{i} binary" for i in range(6))
    met = hopeful.mapInArrow(contexts, schema).repartition(n, "bucket").sortWithinPartitions("bucket")
    spans = met.mapInArrow(cover, "doc_id long, c0 binary, c1 binary").groupBy("doc_id").agg(F.collect_list(F.struct("c0", "c1")).alias("spans"))
    return texts.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "spans")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, depth: int = 50, digest: bool = True) -> DataFrame:
    """What is left of every document: RESULT, or (doc_id, kept, spans) with the remaining bytes if not ``digest``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, data, parts in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
                runs: list[tuple[int, int]] = []
                if parts:
                    found = np.stack([np.frombuffer(b"".join(p[c] for p in parts), np.uint32) for c in ("c0", "c1")], 1)
                    runs = merged(found[np.argsort(found[:, 0], kind="stable")])
                kept = b"".join(data[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True)) if runs else data
                if digest:
                    rows.append((doc_id, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                else:
                    rows.append((doc_id, kept, [{"start": x, "end": y} for x, y in runs]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    schema = RESULT if digest else "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
    loose = text_column(docs).filter("doc_id is null").select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(None).cast("array<struct<c0:binary,c1:binary>>").alias("spans"))
    return find_repeats(docs, depth).unionByName(loose).mapInArrow(cut, schema)
