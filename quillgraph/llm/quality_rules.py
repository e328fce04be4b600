"""Quality rules: counts over words and lines, and an n-gram perplexity band per language.

The language model is a character 5-gram model over code points as they are, with modified Kneser-Ney smoothing. Its
n-grams have no bound but what the corpus holds. Spark sums the counts that each task has pre-aggregated, smooths them
order by order in joins, and keeps the model as rows of hashed n-grams. A text is scored by the model of the other half
of its language's texts (halves by hash, so exact copies are in one), as a high order would give a text's own n-grams
back to it. Scoring looks n-grams up in sorted hash arrays. Models are sent to the executors in parts of so many n-grams,
each part with the texts that it scores; a model larger than a part is joined instead: each block of its texts meets the
n-grams that occur in it. A document whose perplexity lies outside its language's band is rejected. A band is what the
language's own quartiles span, widened by a factor of their distance.

Nulls: a null text is empty (no words, so it fails the base rules); a null language and an empty one are one language of
their own; a null doc_id is carried. A language with texts in one half only has no perplexity there (null), and no text of
it is rejected for that. Repeated rows are judged apart. Texts of any length are read whole. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, frugal, give_back, mix64, slices, written

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: Order of the model over code points, and how many code points there are.
LONG, UNIVERSE = 5, 0x110000
#: Texts that are counted or scored together hold about so many characters.
CHUNK = 1 << 19
#: N-grams (16 bytes each) of the models that are sent to all executors at a time; a model of more is joined.
MOST_NGRAMS = 1 << 21
#: Where the model is joined, a block of texts holds about so many characters.
BLOCK = 16_000_000
#: A task holds up to about so many n-grams while it counts.
HELD = 1 << 21
#: Bands of up to so many languages are sent to all executors, and joined beyond that; likewise, beyond that all models are joined.
MOST_LANGUAGES = 10_000
#: Characters are numbered anew for each chunk of text; so many bits each let an n-gram be one integer.
DENSE = 12


def base_counts(texts: list[str]) -> np.ndarray:
    """Rows of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, one for each text.

    Words meet as 64-bit hashes; the 3-word windows of many texts are sorted together, each mixed with its text.
    """
    out = np.zeros((len(texts), 5), np.int64)
    for part in _chunks(texts):
        own, rows = texts[part], out[part]
        split = [t.encode().split() for t in own]  # on bytes, white space is just the six ASCII characters
        rows[:, 0] = n = np.fromiter(map(len, split), np.int64, len(split))
        rows[:, 1] = [len(t) - sum(map(t.count, SPACES)) for t in own]
        rows[:, 2] = [sum(map(t.count, SYMBOLS)) for t in own]
        for i, t in enumerate(own):
            if "\n" in t:
                lines = [x for x in t.split("\n") if x.strip(SPACES)]
                rows[i, 3] = len(lines) - len(set(lines))
        w = np.fromiter((h for ws in split for h in map(hash, ws)), np.int64, int(n.sum())).view(np.uint64)
        if len(w) < 3:
            continue
        text = np.repeat(np.arange(len(own), dtype=np.uint64), n)
        windows = mix64(mix64(mix64(w[:-2]) + w[1:-1]) + w[2:] + (text[2:] << np.uint64(40)))
        inside = text[:-2] == text[2:]
        windows, at = windows[inside], np.flatnonzero(inside)
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        twice = at[order[np.append(same, False) | np.append(False, same)]] if len(order) else at
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[twice + k] = True
        rows[:, 4] = np.bincount(text[covered].astype(np.int64), minlength=len(own))
    return out


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def _chunks(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _language(docs: DataFrame):
    return F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def pointed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each behind LONG - 1 bounds (0), and where each text begins. U+0000 in a text is read as U+0001."""
    gap = "\0" * (LONG - 1)
    points = np.frombuffer((gap + gap.join(t.replace("\0", "\1") for t in texts)).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, np.cumsum(lengths + LONG - 1) - lengths


_POWERS = [pow(0x9E3779B97F4A7C15, m, 1 << 64) for m in range(LONG)]


def hashed(mixed: np.ndarray, ends: slice | np.ndarray, k: int) -> np.ndarray:
    """64-bit keys of the k-grams that end at ``ends``; ``mixed`` is mix64 of the code points plus one."""
    at = (lambda m: mixed[ends.start - m : ends.stop - m]) if isinstance(ends, slice) else (lambda m: mixed[ends - m])
    out = np.zeros(ends.stop - ends.start if isinstance(ends, slice) else len(ends), np.uint64)
    for m in range(k):
        out += at(m) * np.uint64(_POWERS[m])
    return out


def _mixed(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(np.uint64) + np.uint64(1))


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and code points of several parts as one."""
    keys, n, points = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    first = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    return keys[order[first]], np.add.reduceat(n[order].astype(np.int64), first), points[order[first]]


def modelled(docs: DataFrame) -> DataFrame:
    """language, text, and the models that a text is counted in and scored by: its language with its half and the other."""
    rows = docs.select(*(F.col(c).cast("long").alias(c) for c in docs.columns if c == "doc_id"), _language(docs).alias("language"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    return rows.withColumns({"own": F.concat(half.cast("string"), "language"), "other": F.concat((1 - half).cast("string"), "language")})


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and code points of the distinct n-grams that end at a text's characters, in small types."""
    ends = np.flatnonzero(points[LONG - 1 :]) + LONG - 1
    present = np.flatnonzero(np.bincount(points, minlength=1))
    if len(present) > 1 << DENSE:
        keys, first, n = np.unique(hashed(_mixed(points), ends, LONG), return_index=True, return_counts=True)
        return keys, n.astype(np.uint32), _narrow(np.stack([points[ends[first] - m] for m in range(LONG - 1, -1, -1)], axis=1))
    number = np.zeros(int(present[-1]) + 1, np.uint64)
    number[present] = np.arange(len(present))
    small, packed = number[points], np.zeros(len(ends), np.uint64)
    for m in range(LONG - 1, -1, -1):
        packed = packed << np.uint64(DENSE) | small[ends - m]
    packed, n = np.unique(packed, return_counts=True)
    grams = np.stack([present[(packed >> np.uint64(DENSE * m) & np.uint64((1 << DENSE) - 1)).astype(np.int64)] for m in range(LONG - 1, -1, -1)], axis=1)
    return hashed(_mixed(grams.ravel()), np.arange(LONG - 1, grams.size, LONG), LONG), n.astype(np.uint32), _narrow(grams)


def _narrow(points: np.ndarray) -> np.ndarray:
    return points.astype(np.uint16 if not points.size or points.max() < 1 << 16 else np.uint32)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(model, gram, n) over every text. Each task counts before anything is shuffled."""

    def rows_of(model: str, part: tuple) -> Iterator[pa.RecordBatch]:
        _, n, points = part
        for i in range(0, len(n), 100_000):
            own = np.ascontiguousarray(points[i : i + 100_000], "<u4").view(f"<U{LONG}").ravel().tolist()  # no n-gram ends with a bound
            yield pa.RecordBatch.from_arrays([pa.array([model] * len(own), pa.string()), pa.array(own, pa.string()), pa.array(n[i : i + 100_000], pa.int64())], names=["model", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        for b in (part for batch in batches for part in slices(batch)):
            by: dict[str, list[str]] = {}
            for model, text in zip(b["own"].to_pylist(), b["text"].to_pylist(), strict=True):
                if text:
                    by.setdefault(model, []).append(text)
            for model, texts in by.items():
                for part in _chunks(texts):
                    held.setdefault(model, []).append(_counted(pointed(texts[part])[0]))
            if sum(len(x[0]) for own in held.values() for x in own) > HELD:
                held = {model: [_summed(own)] for model, own in held.items()}
                if sum(len(own[0][0]) for own in held.values()) > HELD // 2:
                    for model, own in held.items():
                        yield from rows_of(model, own[0])
                    held = {}
        for model, own in held.items():
            yield from rows_of(model, _summed(own))

    return modelled(docs).select("own", "text").mapInArrow(frugal(run), "model string, gram string, n long").groupBy("model", "gram").agg(F.sum("n").alias("n"))


MODEL = "model string, key long, p float, backoff float"


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): what Kneser-Ney takes off the counts 1, 2 and from 3, by the counts of counts."""
    of = counts.groupBy("model").agg(*(F.greatest(F.sum((F.col("n") == i).cast("double")), F.lit(1.0)).alias(f"of{i}") for i in range(1, 5)))
    y = F.col("of1") / (F.col("of1") + 2 * F.col("of2"))
    d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"of{i + 1}") / F.col(f"of{i}"), F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
    return of.select("model", *d)


def fit(docs: DataFrame) -> DataFrame:
    """The model as MODEL rows: log probability (NaN for what is only a context) and log back-off weight of each n-gram.

    Every order is smoothed by joins with its contexts and the order below; the key of the empty context is 0.
    """
    counts = {LONG: written(count_ngrams(docs), "ngrams")}
    for k in range(LONG - 1, 0, -1):  # continuation counts: the distinct symbols before
        counts[k] = written(counts[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    below: DataFrame | None = None
    probabilities, contexts = {}, {}
    for k in range(1, LONG + 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = counts[k].join(beside(written(_discounts(counts[k]), "discounts")), "model").select("model", "gram", "n", d.alias("d"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("lower"))
        weights = contexts[k - 1] = written(own.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma")), "contexts")
        rows = own.join(weights, ["model", "context"])
        rows = rows.withColumn("p_lower", F.lit(1 / UNIVERSE)) if below is None else rows.join(below.select("model", F.col("gram").alias("lower"), F.col("p").alias("p_lower")), ["model", "lower"])
        below = probabilities[k] = written(rows.select("model", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p_lower")).alias("p")), "probabilities")
    logs = None
    for k in range(LONG + 1):
        p = probabilities[k].select("model", "gram", F.log("p").alias("p")) if k else None
        w = contexts[k].select("model", F.col("context").alias("gram"), F.log("gamma").alias("backoff")) if k < LONG else None
        both = p.withColumn("backoff", F.lit(0.0)) if w is None else w.select("model", "gram", F.lit(None).cast("double").alias("p"), "backoff") if p is None else p.join(w, ["model", "gram"], "full")
        logs = both if logs is None else logs.unionByName(both)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams_ = b["gram"].to_pylist()
            lengths = np.fromiter(map(len, grams_), np.int64, len(grams_))
            mixed, ends, keys = _mixed(np.frombuffer("".join(grams_).encode("utf-32-le"), np.uint32)), np.cumsum(lengths) - 1, np.zeros(len(grams_), np.uint64)
            for k in range(1, LONG + 1):
                keys[lengths == k] = hashed(mixed, ends[lengths == k], k)
            yield pa.RecordBatch.from_arrays([b["model"], pa.array(keys.view(np.int64)), b["p"], b["backoff"]], names=["model", "key", "p", "backoff"])

    logs = logs.select("model", "gram", F.coalesce("p", F.lit(float("nan"))).cast("float").alias("p"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff"))
    return written(logs.mapInArrow(keyed, MODEL), "model")


@dataclass(frozen=True)
class Arrays:
    """A model: sorted keys (hashes of n-grams), log probabilities and log back-off weights."""

    keys: np.ndarray
    p: np.ndarray
    backoff: np.ndarray

    @cached_property
    def places(self) -> tuple[np.uint64, np.ndarray]:
        """Where the keys with each value of their upper bits begin: as many values as keys, so a search is a step or two."""
        bits = max(1, len(self.keys).bit_length() - 1)
        shift = np.uint64(64 - bits)
        return shift, np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32)

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place for each wanted key, and whether the key is there."""
        shift, first = self.places
        top = len(self.keys) - 1
        at = np.minimum(first[(want >> shift).astype(np.int64)], top).astype(np.int64)
        behind = np.flatnonzero((self.keys[at] < want) & (at < top))
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] < top]
            behind = behind[self.keys[at[behind]] < want[behind]]
        return at, self.keys[at] == want


def arrays(rows: pa.Table) -> dict[str, Arrays]:
    """The models of MODEL rows by name."""
    out: dict[str, Arrays] = {}
    coded_ = pc.dictionary_encode(pa.chunked_array(rows["model"].chunks, pa.string())).combine_chunks()
    which = coded_.indices.to_numpy(zero_copy_only=False)
    keys, p, backoff = (rows[c].to_numpy() for c in ("key", "p", "backoff"))
    keys = keys.view(np.uint64)
    for i, name in enumerate(coded_.dictionary.to_pylist()):
        own = np.flatnonzero(which == i)
        own = own[np.argsort(keys[own])]
        out[name] = Arrays(keys[own], p[own], backoff[own])
    return out


def perplexities(texts: list[str], model: Arrays | None) -> np.ndarray:
    """Mean negative log probability by character (the log of the perplexity); 0 for empty texts, NaN without a model."""
    out = np.full(len(texts), np.nan)
    if model is not None:
        for part in _chunks(texts):
            out[part] = _perplexities(texts[part], model)
    out[[not t for t in texts]] = 0
    return out


def _perplexities(texts: list[str], model: Arrays) -> np.ndarray:
    points, starts = pointed(texts)
    mixed = _mixed(points)
    logs = np.zeros(len(points))
    ends: slice | np.ndarray = slice(LONG - 1, len(points))
    open_ = np.arange(LONG - 1, len(points))
    for k in range(LONG, -1, -1):  # backs off where an n-gram was never seen; order 0 is the empty context
        i, hit = model.find(hashed(mixed, ends, k))
        hit &= ~np.isnan(model.p[i])
        logs[open_[hit]] += model.p[i[hit]]
        open_ = ends = open_[~hit]
        if k:
            i, there = model.find(hashed(mixed, open_ - 1, k - 1))
            logs[open_] += np.where(there, model.backoff[i], 0)
    logs[open_] -= np.log(UNIVERSE)
    sums = np.concatenate([[0], np.cumsum(logs)])
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return -(sums[starts + n] - sums[starts]) / np.maximum(n, 1)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, language string, log_perplexity double"


def _measured(b: pa.RecordBatch, models: dict[str, Arrays], keep: list[str]) -> pa.RecordBatch:
    texts, others = b["text"].to_pylist(), b["other"].to_pylist()
    counts = base_counts(texts)
    scores = np.zeros(len(texts))
    for model in set(others):
        own = [i for i, x in enumerate(others) if x == model]
        scores[own] = perplexities([texts[i] for i in own], models.get(model))
    columns = [pa.array(c) for c in counts.T]
    failed = pa.array(base_failed(counts[:, 0], counts[:, 4]))
    return pa.RecordBatch.from_arrays([*(b[c] for c in keep), *columns, failed, b["language"], pa.array(scores, mask=np.isnan(scores))], names=[*keep, *(x.split()[0] for x in MEASURES.split(", "))])


def parts_of(sizes: dict[str, int], most: int) -> tuple[list[list[str]], list[str]]:
    """Names of models in parts of at most ``most`` n-grams, and those of larger models."""
    parts: list[list[str]] = [[]]
    room = most
    for name in sorted((x for x, n in sizes.items() if n <= most), key=lambda x: (-sizes[x], x)):
        if sizes[name] > room:
            parts.append([])
            room = most
        parts[-1].append(name)
        room -= sizes[name]
    return parts, sorted(x for x, n in sizes.items() if n > most)


def measure(docs: DataFrame, model: DataFrame, most: int = MOST_NGRAMS) -> DataFrame:
    """doc_id (if there is one) and MEASURES of every document, under written MODEL rows; written, too.

    Each part of the models is sent with the texts that it scores, so every text is scored once, whatever the number of
    parts; a part is dropped from the executors before the next is sent.
    """
    rows = modelled(docs).drop("own")
    keep = [c for c in rows.columns if c == "doc_id"]
    schema = ", ".join([*(f"{c} long" for c in keep), MEASURES])
    counted = model.groupBy("model").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        return written(_measure_joined(rows, model, keep, schema), "measured")
    parts, large = parts_of({r["model"]: r["n"] for r in counted}, most)
    sent_names = [name for part in parts for name in part]
    out = None
    for i, part in enumerate(parts):
        own = F.col("other").isin(part)
        mine = ~F.col("other").isin(sent_names[len(part) :] + large) if i == 0 else own  # texts without a model go with the first part
        sent = docs.sparkSession.sparkContext.broadcast(arrays(model.filter(F.col("model").isin(part)).toArrow()))  # at most ``most`` rows

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in (x for batch in batches for x in slices(batch)):
                yield _measured(b, sent.value, keep)

        measured = written(rows.filter(mine).mapInArrow(frugal(run), schema), "measured")
        sent.destroy()
        give_back()
        out = measured if out is None else out.unionByName(measured)
    if large:
        out = out.unionByName(written(_measure_joined(rows.filter(F.col("other").isin(large)), model, keep, schema), "measured"))
    return out


def _measure_joined(rows: DataFrame, model: DataFrame, keep: list[str], schema: str) -> DataFrame:
    """Deals the texts into blocks; a block meets the part of the model that it looks up."""
    size = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*keep, "text"), F.lit(size // BLOCK + 1)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            by: dict[tuple, list[str]] = {}
            for block, name, text in zip(b["block"].to_pylist(), b["other"].to_pylist(), b["text"].to_pylist(), strict=True):
                by.setdefault((block, name), []).append(text)
            for (block, name), texts in by.items():
                for part in _chunks(texts):
                    points, _ = pointed(texts[part])
                    mixed = _mixed(points)
                    for k in range(LONG + 1):
                        keys = np.unique(hashed(mixed, slice(LONG - 1 - (k < LONG), len(mixed)), k)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array([name] * len(keys), pa.string()), pa.array(keys)], names=["block", "model", "key"])

    asked = dealt.select("block", "other", "text").repartition("block").mapInArrow(frugal(wanted), "block long, model string, key long").distinct()
    answers = asked.join(model, ["model", "key"]).select("block", "model", "key", "p", "backoff")

    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        models = arrays(own)
        return pa.Table.from_batches([_measured(part, models, keep) for b in texts.to_batches() for part in slices(b)])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def bands(measured: DataFrame, widen: float) -> DataFrame:
    """(language, low, high): the quartiles of log perplexity, widened by ``widen`` times their distance."""
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    d = (F.col("q")[1] - F.col("q")[0] + 0.02) * widen
    return measured.filter("not base_failed").groupBy("language").agg(q.alias("q")).select("language", (F.col("q")[0] - d).alias("low"), (F.col("q")[1] + d).alias("high"))


def judge(docs: DataFrame, widen: float = 2.0) -> DataFrame:
    """doc_id, MEASURES, low, high and kept for every document."""
    measured = measure(docs, fit(docs))
    limits = written(bands(measured, widen), "bands")
    few = limits.count() <= MOST_LANGUAGES
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return measured.join(limits.hint("broadcast") if few else limits, "language", "left").withColumn("kept", kept)
