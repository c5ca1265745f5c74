"""Chat formatting by token-level assembly.

A turn is written as  <s> role [INST] text [/INST] </s>  without the blanks.  The four control strings are reserved ids above the
vocabulary; role and text are encoded as segments of their own, in which special tokens' strings are ordinary text, and spliced
between the reserved ids.  The loss mask covers the text ids of the roles that are learned: +1 where such a segment starts and
-1 where it ends, summed up.  Control strings inside a text are escaped by a backslash after their first character (one
more if backslashes stand there already), so that the formatted text can be parsed too and every text comes back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, write_out
from .token_output import Encoder, default_tokenizer

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNED = ("assistant",)
#: Ids after which a conversation goes on in a further part.
PART_TOKENS = 1 << 20
_ESCAPE = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


_FORMATTED = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.S)


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text: no control string stands unescaped inside one."""
    return [(unescape(r), unescape(t)) for r, t in _FORMATTED.findall(text)]


def _letters_of_bytes() -> dict[str, int]:
    """How byte-level files write bytes: visible Latin-1 letters stand for themselves, the others follow 255 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Template:
    """Assembles turns with one tokenizer file and takes them apart again."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tok.encode_special_tokens = True
        self.encoder.special = []
        self.first = self.encoder.tok.get_vocab_size()
        self.bytes_of: list[bytes] | None = None
        if self.encoder.chunked:
            byte = _letters_of_bytes()
            self.bytes_of = [b""] * self.first
            for token, i in self.encoder.tok.get_vocab(with_added_tokens=False).items():
                self.bytes_of[i] = bytes(byte[c] for c in token)
        self.open, self.close, self.begin, self.end = self.first, self.first + 1, self.first + 2, self.first + 3

    def assemble(self, turns: list[tuple[str, str]], learned: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, mask) of each turn."""
        segments = self.encoder.encode([escape(x) for turn in turns for x in turn])
        one = lambda i: np.array([i], np.int32)
        out = []
        for k, (role, _) in enumerate(turns):
            r, t = (segments[2 * k + j].astype(np.int32) for j in (0, 1))
            ids = np.concatenate([one(self.open), r, one(self.begin), t, one(self.end), one(self.close)])
            edge = np.zeros(len(ids) + 1, np.int8)
            if role in learned:
                edge[len(r) + 2] += 1
                edge[len(r) + 2 + len(t)] -= 1
            out.append((ids, np.cumsum(edge[:-1], dtype=np.int8)))
        return out

    def decode(self, spans: list[list[int]]) -> list[str]:
        """Texts of these ids; a byte-level file's ids are bytes in a row."""
        if self.bytes_of is None:
            return self.encoder.tok.decode_batch(spans, skip_special_tokens=False)
        of = self.bytes_of.__getitem__
        return [b"".join(map(of, x)).decode("utf-8", "replace") for x in spans]

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> list[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn, unescaped; a text that the mask covers whole is decoded once."""
        marks = np.flatnonzero(ids >= self.first)
        if len(marks) % 4 or (ids[marks].reshape(-1, 4) != [self.open, self.begin, self.end, self.close]).any():
            raise ValueError("ids out of order")
        covered = np.r_[0, np.cumsum(mask > 0)]
        spans, masked = [], []
        for a, b, c, _ in marks.reshape(-1, 4).tolist():
            spans += [ids[a + 1 : b].tolist(), ids[b + 1 : c].tolist()]
            n = int(covered[c] - covered[b + 1])
            masked.append(None if n == c - b - 1 else ids[b + 1 : c][mask[b + 1 : c] > 0].tolist())
        text = [unescape(x) for x in self.decode(spans)]
        part = iter([unescape(x) for x in self.decode([m for m in masked if m is not None])])
        return [(text[2 * k], text[2 * k + 1], text[2 * k + 1] if m is None else next(part)) for k, m in enumerate(masked)]

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"<s>{escape(r)}[INST]{escape(t)}[/INST]</s>" for r, t in turns)


_TEMPLATES: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _TEMPLATES:
        _TEMPLATES[path] = Template(path)
    return _TEMPLATES[path]


def format_chats(turns: DataFrame, tokenizer: str | None = None, learned: tuple[str, ...] = LEARNED, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, ids, mask, formatted): conversations in order of their turns, in parts of bounded size.

    A null text or role is empty; turns of equal number are ordered by role and text, and null numbers come first; repeated
    rows are turns of their own; a null conv_id is one conversation.  Turns are dealt to tasks by ranges of (conv_id, turn), so
    a long conversation has several tasks; its parts, in their order, hold at most part_tokens ids each (or one turn), cut
    between turns.  No rows give no rows.
    """
    path = tokenizer or default_tokenizer()
    kind = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tpl, now, part, held, size, type_ = template(path), None, TaskContext.get().partitionId() << 32, [], 0, None

        def out():
            ids, mask = (np.concatenate([h[0][k] for h in held]) for k in (0, 1))
            return pa.record_batch([pa.array([now[0]], type_), pa.array([part], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8())), pa.array([tpl.render([h[1] for h in held])])], names=["conv_id", "part", "ids", "mask", "formatted"])

        for b in batches:
            type_ = b.schema.field(0).type
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000).to_pydict()
                rows = list(zip(some["role"], some["text"], strict=True))
                for conv, turn, made in zip(some["conv"], rows, tpl.assemble(rows, learned), strict=True):
                    if held and (now != (conv,) or size + len(made[0]) > part_tokens):
                        yield out()
                        part, held, size = part + 1, [], 0
                    now = (conv,)
                    held.append((made, turn))
                    size += len(made[0])
        if held:
            yield out()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    dealt = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.select("conv", "role", "text").mapInArrow(run, f"conv_id {kind}, part long, ids array<int>, mask array<tinyint>, formatted string")


def parsed(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, part, n_turns, said, learned, formatted_chars) per part, where the parts are: their ids and masks parsed and decoded.

    said holds role, line end, text, line end per turn, learned the texts under the mask.
    """
    path = tokenizer or default_tokenizer()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tpl = template(path)
        for b in batches:
            for at in range(b.num_rows):
                conv, part, ids, mask, text = (b.column(k)[at] for k in range(5))
                turns = tpl.parse(ids.values.to_numpy(), mask.values.to_numpy())
                said = "".join(f"{role}\n{text_}\n" for role, text_, _ in turns)
                row = [pa.array([conv.as_py()], b.schema.field(0).type), pa.array([part.as_py()], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([said]), pa.array(["".join(x for _, _, x in turns)]), pa.array([len(text.as_py())], pa.int64())]
                yield pa.record_batch(row, names=["conv_id", "part", "n_turns", "said", "learned", "formatted_chars"])

    rows = formatted.select("conv_id", "part", "ids", "mask", "formatted")
    return rows.mapInArrow(run, f"conv_id {kind}, part long, n_turns long, said string, learned string, formatted_chars long")


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids and masks, part after part.

    Parts are parsed where they are; a conversation's texts meet in one task for their digests alone, which are sequential.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def out():
            n, all_, chars, loss, total = state
            return pa.record_batch([pa.array([now[0]], type_), pa.array([n], pa.int64()), pa.array([all_.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([total], pa.int64())], names=names)

        for b in batches:
            type_ = b.schema.field(0).type
            for conv, n, said, learned, total in zip(*(b.column(k) for k in range(5)), strict=True):
                if now != (conv.as_py(),):
                    if now is not None:
                        yield out()
                    now, state = (conv.as_py(),), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = learned.as_py()
                state[0] += n.as_py()
                state[1].update(said.as_buffer())
                state[2] += len(text)
                state[3].update(text.encode())
                state[4] += total.as_py()
        if now is not None:
            yield out()

    rows = parsed(formatted, tokenizer).repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(write_out(format_chats(turns.unionByName(more)), "chats"))


_ESCAPED = "regexp_replace(coalesce(text, ''), '([<\\[])(\\\\*)(s>|/s>|INST\\]|/INST\\])', '\\1\\\\\\2\\3', 'g')"
ORACLE = {
    "op8_chat_formatting": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<s>' || role || '[INST]' || {_ESCAPED} || '[/INST]</s>')) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
}
