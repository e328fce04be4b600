"""Chat formatting with typed content parts.

A message's content is plain text or a list of typed parts. A visitor turns the parts into one string in which each
attachment stands as an ordered placeholder, and records what the placeholder refers to and how many tokens it
expands to. Control strings inside texts are escaped reversibly, so the formatted output can be read back.

Nulls: a null text or role is the empty string, a null part or attachment size counts nothing. Ties: rows with the
same turn are ordered by role, then text; repeated rows stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of this template and of other public chat templates.
CONTROL_STRINGS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN_OPEN, TURN_TEXT, TURN_CLOSE = "<|turn|>", "<|text|>", "<|end|>"

_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL_STRINGS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(TURN_OPEN) + "(.*?)" + re.escape(TURN_TEXT) + "(.*?)" + re.escape(TURN_CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    """Doubles every backslash and puts one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


@dataclass
class PartVisitor:
    """Flattens typed parts in order. ``visit_<kind>`` returns the piece of text that stands for the part."""

    tile: int = 512
    tokens_per_tile: int = 170
    audio_tokens_per_second: int = 25
    tokens_per_page: int = 800
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> str:
        if not part:
            return ""
        method = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part.get('type')!r}")
        return method(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        across, down = (max(1, -(-int(part.get(k) or 0) // self.tile)) for k in ("width", "height"))
        return self._placeholder("image", part, across * down * self.tokens_per_tile)

    def visit_audio(self, part: dict) -> str:
        return self._placeholder("audio", part, max(1, round(float(part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> str:
        return self._placeholder("document", part, max(1, int(part.get("pages") or 0)) * self.tokens_per_page)

    def _placeholder(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"position": len(self.attachments), "kind": kind, "ref": part.get("ref") or "", "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_turn(role: str | None, parts: list[dict] | str | None, visitor: PartVisitor) -> str:
    content = [{"type": "text", "text": parts}] if parts is None or isinstance(parts, str) else parts
    return f"{TURN_OPEN}{escape(role or '')}{TURN_TEXT}{''.join(map(visitor.visit, content))}{TURN_CLOSE}\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, content) pairs of a formatted string; placeholders stay in the content as they are."""
    end = 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        end = m.end()
        yield unescape(m[1]), unescape(m[2])
    if end != len(formatted):
        raise ValueError(f"not a formatted conversation, at {end}")


_ATTACHMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
FORMATTED = "conv_id long, turn long, role string, formatted string, attachments array<struct<position:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"


def format_turns(messages: DataFrame, content: str = "text", **options: int) -> DataFrame:
    """One row per message: its formatted piece, its attachments and their expanded token count.

    ``content`` is a string column or an array of structs with ``type`` and, by type, ``text``, ``ref``, ``width``,
    ``height``, ``seconds`` and ``pages``. A row is formatted where it is read; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, refs, tokens = [], [], []
            for role, parts in zip(b["role"].to_pylist(), b["content"].to_pylist(), strict=True):
                visitor = PartVisitor(**options)
                pieces.append(format_turn(role, parts, visitor))
                refs.append(visitor.attachments)
                tokens.append(sum(a["tokens"] for a in visitor.attachments))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], pa.array(pieces, pa.string()), pa.array(refs, pa.list_(_ATTACHMENT)), pa.array(tokens, pa.int64())], names=["conv_id", "turn", "role", "formatted", "attachments", "expanded_tokens"])

    picked = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col(content).alias("content"))
    return picked.mapInArrow(run, FORMATTED)


def assemble(formatted: DataFrame) -> DataFrame:
    """One formatted string per conversation, for writing out; the digests below need no such string."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "formatted", "expanded_tokens")))
    return formatted.groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", F.concat_ws("", "rows.formatted").alias("formatted"), F.aggregate("rows.expanded_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses the formatted pieces again, in order, and digests what they say.

    The pieces of a conversation arrive sorted and are folded one at a time: a conversation of any length needs the
    memory of one turn and two hash states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {}
        current, open_ = None, False
        n = loss = chars = tokens = 0
        turns = masked = None

        def close() -> None:
            for name, value in zip(names, (current, n, turns.hexdigest(), loss, masked.hexdigest(), chars, tokens), strict=True):
                out[name].append(value)

        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types, strict=True)], names=names)
        for b in batches:
            out = {k: [] for k in names}
            for conv, piece, extra in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["expanded_tokens"].to_pylist(), strict=True):
                if not open_ or conv != current:
                    if open_:
                        close()
                    current, open_, n, loss, chars, tokens = conv, True, 0, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                chars += len(piece)
                tokens += extra
                for role, text in parse_turns(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        loss += len(text)
                        masked.update(text.encode())
            yield batch()
        if open_:
            out = {k: [] for k in names}
            close()
            yield batch()

    dealt = formatted.select("conv_id", "turn", "role", "formatted", "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return dealt.select("conv_id", "formatted", "expanded_tokens").mapInArrow(run, DIGEST)
