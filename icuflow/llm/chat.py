"""Chat formatting: whole conversations rendered, encoded once with offsets, loss mask by turn spans.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. The two markers are special tokens, so no token crosses a turn's
edge. Control strings inside roles and texts are broken by an escape character after their first character; escape characters
of the text are doubled, so reading back restores every text exactly.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.batches import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
FORMATTED = (
    "conv_id bigint, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, "
    "loss_mask array<boolean>, turns array<struct<role:string,start:int,end:int>>"
)
SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_tokens bigint, loss_tokens bigint"
)


@dataclass(frozen=True)
class Template:
    """Markers around a turn, the strings no text may hold unescaped, and the role whose text is learnt."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    mark: str = "⁠"
    learnt: str = "assistant"
    _found: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        every = (self.start, self.end, *self.controls)
        if any(self.mark in c or len(c) < 2 for c in every):
            raise ValueError("control strings have two characters or more and no escape mark")
        if any(self.end.startswith(c[k:]) for c in every for k in range(1, len(c))):
            raise ValueError("the end of a text and the end marker may not make a control string")
        object.__setattr__(self, "_found", re.compile(f"(?s)(?=(?:{'|'.join(map(re.escape, every))}))(.)"))

    def escape(self, text: str) -> str:
        return self._found.sub(rf"\1{self.mark}", text.replace(self.mark, self.mark * 2))

    def unescape(self, text: str) -> str:
        return re.sub(f"{self.mark}({self.mark}?)", r"\1", text)

    def render(self, turns: Iterable[tuple[str, str]]) -> tuple[str, list[dict]]:
        """The rendered conversation and the spans of its escaped texts."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.start}{self.escape(role).replace(chr(10), self.mark + chr(10))}\n", self.escape(text)
            spans.append({"role": role, "start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, self.end, "\n"]
            at += len(head) + len(body) + len(self.end) + 1
        return "".join(parts), spans

    def parse(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start, end) of every turn, read from the rendered conversation alone."""
        line = re.compile(rf"(?<!{self.mark})(?:{self.mark * 2})*(\n)")  # an odd number of marks: a line break of the role
        at = 0
        while (at := formatted.find(self.start, at)) >= 0:
            head = at + len(self.start)
            cut = line.search(formatted, head).start(1)
            end = formatted.index(self.end, cut)
            yield self.unescape(formatted[head:cut]), self.unescape(formatted[cut + 1 : end]), cut + 1, end
            at = end


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that share a character with a span; spans are sorted and apart."""
    spans = [s for s in spans if s[1] > s[0]]
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans).T
    i = np.searchsorted(high, starts, "right")
    return (i < len(low)) & (low[np.minimum(i, len(low) - 1)] < ends)


def masked_pieces(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of the spans that masked tokens cover, in order; tokens of one character's bytes count once."""
    starts, ends = starts[mask], ends[mask]
    out = []
    for low, high in spans:
        a, b = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        at = low
        for s, e in zip(np.maximum(starts[a:b], low), np.minimum(ends[a:b], high)):
            s = max(s, at)
            if e > s:
                if out and out[-1][1] == s and s != low:
                    out[-1] = (out[-1][0], e)
                else:
                    out.append((s, e))
                at = e
    return [(int(s), int(e)) for s, e in out]


def _tokenizer(path: str, template: Template):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([template.start, template.end])
    return tokenizer


def format_conversations(conversations: DataFrame, template: Template = Template(), tokenizer: str = TOKENIZER, batch_chars: int = 500_000) -> DataFrame:
    """One row per conversation: rendered text, token ids with character offsets, loss mask, turn spans.

    Turns stand in order of turn, then role, then text; nulls come first. A null role or text is empty; rows without conv_id
    make one conversation without id; repeated rows are repeated turns; an empty table gives no rows; further columns are not read.
    Rows are dealt by conversation and sorted by Spark, then read as a stream: a task holds ``batch_chars`` characters or one
    conversation, which is one row of the result in any case.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer, template)
        each = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))))
        held, size = [], 0
        for conv, turns in groupby(each, lambda row: row[0]):
            text, spans = template.render((role or "", body or "") for _, role, body in turns)
            held.append((conv, text, spans))
            size += len(text)
            if size >= batch_chars:
                yield encoded(encoder, held)
                held, size = [], 0
        if held:
            yield encoded(encoder, held)

    def encoded(encoder, held) -> pa.RecordBatch:
        out = []
        for (conv, text, spans), e in zip(held, encoder.encode_batch([h[1] for h in held], add_special_tokens=False)):
            at = np.array(e.offsets, np.int32).reshape(-1, 2)
            mask = loss_mask(at[:, 0], at[:, 1], [(s["start"], s["end"]) for s in spans if s["role"] == template.learnt])
            out.append((conv, text, np.array(e.ids, np.int32), at[:, 0], at[:, 1], mask, spans))
        kinds = (pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), SPANS)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
            names=["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask", "turns"],
        )

    return small_batches(rows).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Turn and loss digests of formatted conversations, from the rendered text, the offsets and the mask alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch["formatted"][i].as_py()
                starts, ends = (np.asarray(batch[c][i].values) for c in ("token_starts", "token_ends"))
                mask = np.asarray(batch["loss_mask"][i].values.to_numpy(zero_copy_only=False), bool)
                every, loss, n, chars, spans = hashlib.sha256(), hashlib.sha256(), 0, 0, []
                for role, body, low, high in template.parse(text):
                    every.update(f"{role}\n{body}\n".encode())
                    spans.append((low, high))
                    n += 1
                for low, high in spans:
                    pieces = masked_pieces(starts, ends, mask, [(low, high)])
                    learnt = template.unescape("".join(text[s:e] for s, e in pieces))
                    loss.update(learnt.encode())
                    chars += len(learnt)
                out.append((batch["conv_id"][i].as_py(), n, every.hexdigest(), chars, loss.hexdigest(), len(text), len(mask), int(mask.sum())))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in DIGEST.split(", ")])

    return small_batches(formatted).mapInArrow(run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose user and assistant both write control strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
