"""Offset-mapped token attribution.

A whole document is encoded once. The tokens' character spans are then interval-joined to its sections (by default its
lines; any function from a text to its sections' starts does) or to its fields (several columns, read as one text with a
line break behind each but the last, which belongs to the field before), and a token that crosses a boundary is
allocated by an explicit rule:
``start`` (the section of its first character), ``end`` (of its last one) or ``majority`` (the section that holds most
of its characters, the earlier one on a tie).

Nulls: a null text or field is empty; an empty text has one empty section with no tokens. A null doc_id is carried.
Repeated rows, and rows that share a doc_id, are counted apart. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column

RULES = ("start", "end", "majority")
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


def load_encoding(path: str, pattern: str | None = None):
    """A byte-level encoding from a ranks file (base64 token, rank); the pattern is that of the vocabulary."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def token_spans(ids: np.ndarray, widths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token: a character that tokens share belongs to each of them."""
    ends = np.cumsum(widths[ids])
    at = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    return at[ends - widths[ids]], at[ends - 1]


def line_sections(text: str) -> np.ndarray:
    """Starts of the lines; a line's \\n belongs to it."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.flatnonzero(code == 10) + 1])


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The interval join: section of each token, and whether the token crosses a boundary."""
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, last, "right") - 1
    crossing = a != b
    if rule == "start" or not crossing.any():
        return a, crossing
    if rule == "end":
        return b, crossing
    to = a.copy()
    for i in np.flatnonzero(crossing):
        edges = np.concatenate([[first[i]], starts[a[i] + 1 : b[i] + 1], [last[i] + 1]])
        to[i] = a[i] + int(np.argmax(np.diff(edges)))
    return to, crossing


#: Stands behind each field but the last.
JOINT = "\n"


def count_tokens(docs: DataFrame, ranks_path: str, rule: str = "majority", sections: Callable[[str], np.ndarray] = line_sections, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per section (or field) of every document: its character span and the tokens allocated to it. No shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ranks = load_encoding(ranks_path)
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            widths[rank] = len(token)
        for b in (part for batch in batches for part in slices(batch)):
            ids: list[int | None] = []
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            ends = b["ends"].to_pylist() if fields else [None] * b.num_rows
            for doc_id, text, own in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), ends, strict=True):
                starts = sections(text) if own is None else np.array([0, *own[:-1]], np.int64)
                n, crossing = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
                if text:
                    to, crosses = attribute(*token_spans(np.array(encoding.encode_ordinary(text)), widths, text.encode()), starts, rule)
                    n = np.bincount(to, minlength=len(starts))
                    crossing = np.bincount(to[crosses], minlength=len(starts))
                ids += [doc_id] * len(starts)
                for c, x in zip(columns, (np.arange(len(starts)), starts, np.append(starts[1:], len(text)), n, crossing), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c), pa.int64()) for c in columns)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    if not fields:
        return text_column(docs).mapInArrow(run, SCHEMA)
    parts = [F.concat(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("" if i == len(fields) - 1 else JOINT)) for i, c in enumerate(fields)]
    ends = [sum((F.char_length(p).cast("long") for p in parts[: i + 1]), F.lit(0).cast("long")) for i in range(len(parts))]
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*parts).alias("text"), F.array(*ends).alias("ends"))
    return whole.mapInArrow(run, SCHEMA)
