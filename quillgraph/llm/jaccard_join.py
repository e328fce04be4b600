"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of similarity t or more share a token among the first n - ceil(t * n) + 1 of each, under every global order.
An order that puts tokens of one set alone before all others lets a set out that has that many of them: it links with
nothing. A fixed share of the token space (by hash) is counted for that, over all documents, which leaves few sets.

Of these, candidates come from a rare-first order, and a candidate pair must also share a prefix token under two more
orders: the prefixes travel to the pairs, and only sets of pairs that every order lets through travel to be compared. The
rare-first orders rest on a counting sketch of fixed size: as any order is correct, a coarse one only costs time.

Documents with equal sets are one node. Where nodes meet behind a common token, two bounds discard pairs before they are
emitted: the sizes', and that of parity bitmaps, whose distance is never more than that of the sets. Members of a large
group then meet along a forest over the components known so far: a pair that passes the bounds stands for all others
between the two components, until it is compared. Rounds of that leave few components, and all pairs across these that
pass the bounds are compared in the end. Groups with one least node, which mostly hold the same nodes, meet together, so
that a pair is made once and not behind each of its common tokens; more members than a block holds are dealt out by pairs
of blocks, in the first round by blocks alone.
Sets are compared exactly (as sorted 64-bit token hashes).

Nulls: a null text is empty, and empty texts link with nothing. A document with a null doc_id links like any other, but
its id is never that of a component. Repeated rows, and rows with one doc_id and several texts, are documents of their
own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, beside, dealt_out, frugal, mix64, slices, small_batches, text_column, written
from .components import connected_components

SKETCH, CHUNKS = 1 << 20, 64
#: Names of kept documents are sent to all executors up to this number (24 bytes each), and joined beyond it.
MOST_SENT = 1 << 20
#: Orders after the first differ in how they break ties.
SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)
#: Words of 64 bits in a parity bitmap, and in the one that the last round compares by.
WIDTH, WIDE = 8, 32
#: Groups of more nodes meet along forests first.
SMALL_GROUP = 16
#: Rounds of meeting along forests before all pairs across components are compared.
FOREST_ROUNDS = 3
#: Members of a large group that meet in one task.
BLOCK = 512


def token_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct token hashes of each text: its shingles of so many words, or all its words as one if fewer."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    out = []
    for t in texts:
        ws = ascii_lower(t).encode().split()
        w = np.fromiter(map(digest, ws), np.uint64, len(ws))
        k = min(words, len(w))
        if not k:
            out.append(w)
            continue
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = mix64(h + w[i : n + i])
        out.append(np.unique(h))
    return out


def node_of(tokens: np.ndarray) -> int:
    """An identity of a set, the same for equal sets."""
    return int(np.int64(np.uint64(mix64(np.array([mix64(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0]).view(np.int64)))


def ordered(tokens: np.ndarray, sketch: np.ndarray, order: int) -> np.ndarray:
    """Tokens in a global order: by the level of their count in the sketch, then by a hash of the order's own."""
    level = sketch[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    return tokens[np.lexsort((mix64(tokens ^ SEEDS[order]), level))]


def prefix(tokens: np.ndarray, sketch: np.ndarray, order: int, percent: int) -> np.ndarray:
    n = len(tokens)
    return ordered(tokens, sketch, order)[: n - -(-percent * n // 100) + 1]


def levels(sketch: np.ndarray) -> np.ndarray:
    """Counts as levels: 0 up to what chance puts into a cell, then one more for each doubling."""
    noise = np.median(sketch) + 4 * np.sqrt(np.median(sketch)) + 8
    return np.ceil(np.log2(np.maximum(sketch / noise, 1))).astype(np.uint8)


def parity(tokens: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A bitmap in which each token flips one bit: two sets' bitmaps differ in no more bits than the sets in tokens."""
    bits = np.bincount((mix64(tokens) >> np.uint64(40)).astype(np.int64) % (64 * width), minlength=64 * width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def near(sizes: np.ndarray, bits: np.ndarray, i: int, percent: int, block: np.ndarray | None = None) -> np.ndarray:
    """Which members behind the i-th of a group (sorted by size) the bounds allow to link with it; of other blocks only, if given."""
    end = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
    x = np.arange(i + 1, end) if block is None else i + 1 + np.flatnonzero(block[i + 1 : end] != block[i])
    apart = np.bitwise_count(bits[x] ^ bits[i]).sum(1, dtype=np.int64)
    return x[apart * (100 + percent) <= (sizes[x] + sizes[i]) * (100 - percent)]


def all_pairs(nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, components: np.ndarray, percent: int, block: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs across components (and blocks) that pass the bounds; the group is sorted by size."""
    for i in range(len(nodes)):
        for j in (x := near(sizes, bits, i, percent, block))[components[x] != components[i]].tolist():
            yield int(nodes[i]), int(nodes[j])


class Labels:
    """Components as they grow together."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def of(self, components: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels that there are, and each member's as a place among them."""
        own, at = np.unique(components, return_inverse=True)
        roots, to = np.unique(np.array([self._find(c) for c in own.tolist()], np.int64), return_inverse=True)
        return roots, to[at]

    def _find(self, c: int) -> int:
        path = []
        while (up := self.root.get(c, c)) != c:
            path.append(c)
            c = up
        self.root.update(dict.fromkeys(path, c))
        return c

    def join(self, one: int, others: list[int]) -> None:
        self.root.update({x: one for x in others if x != one})


def forest(nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, components: np.ndarray, percent: int, block: np.ndarray | None = None, labels: Labels | None = None) -> Iterator[tuple[int, int]]:
    """Of those pairs, so many that they connect what all of them would; ``labels`` knows what other groups connect."""
    labels = labels or Labels()
    roots, label = labels.of(components)
    for i in range(len(nodes)):
        x = near(sizes, bits, i, percent, block)
        x = x[label[x] != label[i]]
        if len(x):
            other, at = np.unique(label[x], return_index=True)
            for j in x[at].tolist():
                yield int(nodes[i]), int(nodes[j])
            labels.join(int(roots[label[i]]), roots[other].tolist())
            label[np.isin(label, other)] = label[i]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _bytes(rows: list) -> pa.Array:
    return pa.array(rows, pa.binary())


def digest() -> Column:
    """A digest of ``text``: with doc_id it names a document, also where there is no doc_id or several texts have one."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _digested(docs: DataFrame) -> DataFrame:
    return text_column(docs).withColumn("digest", digest())


def describe(docs: DataFrame, words: int, share: int) -> DataFrame:
    """(doc_id, digest, n, node, counted) of every document; one without words has no node.

    ``counted`` holds one token hash in ``share``, 7 bytes each: what ``lone_tokens`` counts, so that the texts need not
    be read again for it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            sets = token_sets(b["text"].to_pylist(), words)
            counted = [np.ascontiguousarray(s[mix64(s) % np.uint64(share) == 0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), _bytes(counted)], names=["doc_id", "digest", "n", "node", "counted"])

    return written(_digested(docs).mapInArrow(frugal(run), "doc_id long, digest long, n long, node long, counted binary"), "nodes")


def _rows_by(key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each key (sorted together with the columns), with its part of each column as bytes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)
    parts = list(zip(edges.tolist(), edges[1:].tolist(), strict=False))
    out = [pa.array(key[edges[:-1]].astype(np.int32), pa.int32())]
    out += [_bytes([c[i:j].tobytes() for i, j in parts]) for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays(out, names=["bucket", *(f"c{i}" for i in range(len(columns)))])


def _by_bucket(batches: Iterator[pa.RecordBatch], types: tuple) -> Iterator[list[np.ndarray]]:
    """The columns of one bucket at a time; rows come sorted by bucket."""
    current, held = None, []
    arrays = lambda: [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)]
    for b in batches:
        for bucket, *rest in zip(*(b[i].to_pylist() for i in range(len(types) + 1)), strict=True):
            if bucket != current and held:
                yield arrays()
                held = []
            current = bucket
            held.append(rest)
    if held:
        yield arrays()


def counted_share(percent: int) -> int:
    """One token hash in so many is counted: at least twice the part of its tokens that lets a set out."""
    return max(1, 40 // (100 - percent)) if percent < 100 else 40


def lone_tokens(nodes: DataFrame) -> DataFrame:
    """(node, lone): how many of a node's counted tokens no other node has; nodes without any are missing."""
    n = dealt_out(nodes.select("node", "counted"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "counted")):
            raw = b["counted"].to_pylist()
            if any(raw):
                node = np.repeat(np.array(b["node"].to_pylist()), [len(x) // 7 for x in raw])
                t = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 7)
                bucket = (t[:, 0].astype(np.uint64) | t[:, 1].astype(np.uint64) << np.uint64(8)) % np.uint64(n)
                yield _rows_by(bucket, [node, np.ascontiguousarray(t[:, 2:])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, raw in _by_bucket(batches, (np.int64, np.uint8)):
            wide = np.zeros((len(node), 8), np.uint8)
            wide[:, :5] = raw.reshape(-1, 5)
            t = wide.view("<u8").reshape(-1)
            order = np.lexsort((node, t))
            t, node = t[order], node[order]
            new = np.append(True, t[1:] != t[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:] - 1, len(t) - 1)
            lone, times = np.unique(node[first[node[first] == node[last]]], return_counts=True)
            yield _rows_by(lone.view(np.uint64) % np.uint64(n), [lone, times.astype(np.uint32)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, times in _by_bucket(batches, (np.int64, np.uint32)):
            own, at = np.unique(node, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(at, times).astype(np.int64))], names=["node", "lone"])

    packed = "bucket int, c0 binary, c1 binary"
    counted = nodes.filter("node is not null").select("node", "counted").mapInArrow(frugal(emit), packed).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(count), packed)
    return counted.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "node long, lone long")


def possible_sets(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, tokens, wide) of the nodes that may have a link at all; ``wide`` is a parity bitmap."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            found = token_sets(b["text"].to_pylist(), words)
            keep = [i for i, (s, node) in enumerate(zip(found, b["node"].to_pylist(), strict=True)) if len(s) and node_of(s) == node]
            yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(keep, pa.int64())), _bytes([found[i].tobytes() for i in keep]), _bytes([parity(found[i], WIDE).tobytes() for i in keep])], names=["node", "tokens", "wide"])

    need = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    keepers = nodes.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("k"), F.first("n").alias("n"))
    keepers = keepers.join(lone_tokens(nodes), "node", "left").filter(F.coalesce("lone", F.lit(0)) < need)
    keepers = beside(written(keepers.select("node", F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest")), "keepers"), MOST_SENT)
    texts = _digested(docs).join(keepers, (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("node", "text")
    return written(texts.mapInArrow(frugal(sets), "node long, tokens binary, wide binary").groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("wide").alias("wide")), "tokens")


def sketch_of(sets: DataFrame) -> np.ndarray:
    """The levels of a counting sketch over the tokens of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for b in batches:
            raw = b"".join(b["tokens"].to_pylist())
            counts += np.bincount((np.frombuffer(raw, np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
        if counts.any():
            chunks = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in counts.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), _bytes(chunks)], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b["chunk"].to_pylist(), b["counts"].to_pylist(), strict=True):
                x = np.frombuffer(raw, "<u2" if len(raw) == 2 * SKETCH // CHUNKS else "<u4")
                total[chunk] = total[chunk] + x if chunk in total else x.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _bytes([x.tobytes() for x in total.values()])], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    sketch = np.zeros((CHUNKS, SKETCH // CHUNKS), np.uint64)
    with small_batches(sets.sparkSession):
        rows = sets.select("tokens").mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).collect()  # SKETCH numbers, whatever the input
    for r in rows:
        sketch[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    return levels(sketch.reshape(-1))


PAIRS = "a long, b long"


def candidates(sets: DataFrame, sketch, percent: int) -> DataFrame:
    """Rows of kind 0 (pair a, b) and of kind 1 (group a, node b, size n, bits): the large groups, for later rounds.

    ``sketch`` is a broadcast. Prefix tokens travel packed, a row for each batch and bucket.
    """
    buckets = dealt_out(sets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "tokens")):
            found = [np.frombuffer(x, np.uint64) for x in b["tokens"].to_pylist()]
            if found:
                prefixes = [prefix(x, sketch.value, 0, percent) for x in found]
                n = [len(p) for p in prefixes]
                t = np.concatenate(prefixes)
                rest = (np.array(b["node"].to_pylist()), np.array([len(x) for x in found], np.int32), np.stack([parity(x) for x in found]))
                yield _rows_by((t >> np.uint64(20)) % np.uint64(buckets), [t, *(np.repeat(x, n, axis=0) for x in rest)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "n", "bits"]
        for t, v, n, bits in _by_bucket(batches, (np.uint64, np.int64, np.int32, np.uint64)):
            order = np.lexsort((v, n, t))
            t, v, n, bits = t[order], v[order], n[order].astype(np.int64), bits.reshape(-1, WIDTH)[order]
            edges = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t))
            size = np.diff(edges)
            pairs: set[tuple[int, int]] = set()
            for i in np.flatnonzero((size > 1) & (size <= SMALL_GROUP)).tolist():
                g = slice(edges[i], edges[i + 1])
                pairs.update((min(p), max(p)) for p in all_pairs(v[g], n[g], bits[g], np.arange(size[i]), percent))
            if pairs:
                nothing = [pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(pairs), pa.int32()), *(pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)), *nothing], names=names)
            large = np.repeat(size > SMALL_GROUP, size)
            for some in np.array_split(np.flatnonzero(large), int(large.sum()) // 50_000 + 1) if large.any() else []:
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WIDTH), len(some), [None, pa.py_buffer(bits[some].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(t[some].view(np.int64)), pa.array(v[some]), pa.array(n[some].astype(np.int32)), raw], names=names)

    packed = sets.mapInArrow(frugal(emit), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(meet), "kind int, a long, b long, n int, bits binary")


def across(groups: DataFrame, components: DataFrame, sets: DataFrame, percent: int, turn: int, last: bool) -> DataFrame:
    """Pairs of large groups between nodes that are not yet connected: along forests, or all that pass the bounds.

    The first turn (0) looks inside blocks only; the last round bounds by the wide bitmaps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, place, labels, seen = None, [], None, Labels(), set()

        def pairs() -> pa.RecordBatch:
            component, n, node, block, bits = zip(*held, strict=True)
            component, n, node, block, bits = np.array(component), np.array(n, np.int64), np.array(node), np.array(block), np.frombuffer(b"".join(bits), np.uint64).reshape(len(node), -1)
            order = np.lexsort((node, n))
            apart = block[order] if block.min() != block.max() else None
            found = all_pairs(node[order], n[order], bits[order], component[order], percent, apart) if last else forest(node[order], n[order], bits[order], component[order], percent, apart, labels)
            fresh = [p for p in dict.fromkeys((min(p), max(p)) for p in found) if p not in seen]
            seen.update(fresh)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in fresh], pa.int64()), pa.array([p[1] for p in fresh], pa.int64())], names=["a", "b"])

        for b in batches:
            for home, x, y, g, *rest in zip(*(b[c].to_pylist() for c in ("home", "x", "y", "g", "component", "n", "node", "block", "bits")), strict=True):
                if (home, x, y, g) != at and held:
                    yield pairs()
                    held = []
                if (home, x, y) != place:
                    place, labels, seen = (home, x, y), Labels(), set()
                at = home, x, y, g
                held.append(tuple(rest))
        if held:
            yield pairs()

    placed = groups.select(F.col("a").alias("g"), F.col("b").alias("node"), "n", "bits").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("home"), F.count("*").alias("members")).filter("lo <> hi").select("g", "home", "members")
    apart = written(apart, "groups")
    homes = apart.groupBy("home").agg(F.ceil(F.max("members") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(beside(written(apart.join(homes, "home").select("g", "home", "blocks"), "groups")), "g")
    if last:
        rows = rows.drop("bits").join(sets.select("node", F.col("wide").alias("bits")), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.col("block") if turn == 0 else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("home", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "g", "component", "n", "node", "block", "bits")
    return rows.repartition("home", "x", "y").sortWithinPartitions("home", "x", "y", "g").mapInArrow(frugal(run), PAIRS)


def _meet(rows: DataFrame, pairs: DataFrame, column: str, alike) -> DataFrame:
    """The pairs (a, b) whose two entries in ``column`` of ``rows`` (node, ...) are alike.

    A pair's ``a`` is read once for all its partners, which stream by.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, current = np.zeros(0, np.uint64), None
        for b in batches:
            out = []
            for a, partner, raw in zip(b["a"].to_pylist(), b["b"].to_pylist(), b[column].to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if partner is None:
                    current, hub = a, s
                elif current == a and alike(hub, s):
                    out.append((a, partner))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    rows = rows.select("node", column)
    hubs = rows.join(pairs.select("a").distinct(), F.col("node") == F.col("a"), "left_semi").select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), column)
    partners = pairs.join(rows.withColumnRenamed("node", "b"), "b").select("a", "b", column)
    return hubs.unionByName(partners).repartition("a").sortWithinPartitions(F.col("a"), F.col("b").asc_nulls_first()).mapInArrow(frugal(compare), PAIRS)


def further_prefixes(sets: DataFrame, sketch, percent: int) -> DataFrame:
    """(node, prefixes): how many tokens each prefix under the further orders has, and the prefixes, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "tokens")):
            rows = []
            for raw in b["tokens"].to_pylist():
                own = [prefix(np.frombuffer(raw, np.uint64), sketch.value, k, percent) for k in range(1, len(SEEDS))]
                rows.append(np.concatenate([np.array([len(p) for p in own], np.uint64), *own]).tobytes())
            yield pa.RecordBatch.from_arrays([b["node"], _bytes(rows)], names=["node", "prefixes"])

    return written(sets.select("node", "tokens").mapInArrow(run, "node long, prefixes binary"), "prefixes")


def share_prefixes(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two rows of ``further_prefixes`` have a token in common under every order."""
    orders = len(SEEDS) - 1
    cut = lambda x: np.split(x[orders:], np.cumsum(x[:orders].astype(np.int64))[:-1])
    return all(np.isin(p, q).any() for p, q in zip(cut(a), cut(b), strict=True))


def verify(sets: DataFrame, prefixes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: every further order's filter lets them through, and then their sets agree."""
    return _meet(sets, written(_meet(prefixes, pairs, "prefixes", share_prefixes), "pairs"), "tokens", lambda a, b: linked(a, b, percent))


def place_documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, digest (of the text), n, component and component_id of every document.

    ``component`` is the same for all that links connect, also where they have no doc_id, and null without words;
    ``component_id`` is the least doc_id of a component, null if it has none.
    """
    nodes = describe(docs, words, counted_share(percent))
    sets = possible_sets(docs, nodes, words, percent)
    sketch = docs.sparkSession.sparkContext.broadcast(sketch_of(sets))
    met = written(candidates(sets, sketch, percent), "met")
    prefixes = further_prefixes(sets, sketch, percent)
    sketch.unpersist()
    groups = met.filter("kind = 1")
    pairs = written(met.filter("kind = 0").select("a", "b").distinct(), "pairs")
    links = written(verify(sets, prefixes, pairs, percent), "links")
    components = written(connected_components(links), "components")
    for turn in range(FOREST_ROUNDS + 1):
        more = written(across(groups, components, sets, percent, turn, turn == FOREST_ROUNDS).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        new = written(verify(sets, prefixes, more, percent), "links")
        pairs = pairs.unionByName(more)
        links = links.unionByName(new)
        if not new.isEmpty():
            components = written(connected_components(links), "components")
    own = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(components, "node", "left")
    own = written(own, "components")
    first = beside(written(own.filter("component is not null").groupBy("component").agg(F.min("least").alias("first")), "first"))
    ids = own.join(first, "component", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("first", "least").alias("component_id"))
    return nodes.select("doc_id", "digest", "n", "node").join(written(ids, "components"), "node", "left").drop("node")


def join_documents(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document.

    Documents link whose sets have at least ``percent`` / 100 of their union in common.
    """
    return place_documents(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
