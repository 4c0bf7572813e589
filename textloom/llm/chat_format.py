"""Chat formatting: turns of typed content parts become one marked text, which can be read back.

A turn has a list of parts: text, image, audio or document. A visitor takes them in order; texts are
escaped, every other part leaves a placeholder with its number in the conversation, its reference and
the number of tokens that it expands to. What an answer says is marked as a span of the loss mask.

A conversation is never one value: its turns are sorted within a task and each becomes a segment, a row.
The formatted conversation is its segments in the order of ``seq``, so a turn is all that a task holds,
however long its conversation is. ``read_back`` parses segments, in that order, back to turns.

Escaping puts a backslash before each backslash and each place where a control string of the template
begins, so unescaping is exact for any text.

Null texts and null roles are empty; null parts are none. Turns come in the order of turn (nulls first),
ties by role, then by their parts, repeated rows stay. Rows without a conversation's id are one
conversation. A part of no kind is a text; one of an unknown kind is an attachment of one token. Texts
of any length are formatted whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: One type for all parts; those that a kind doesn't use are null.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHED = ("image", "audio", "document", "attachment")


@dataclass(frozen=True)
class Template:
    open: str = "### "
    named: str = ":\n"  # ends a role
    close: str = "\n</turn>\n"
    trained: tuple[str, ...] = ("assistant",)  # roles whose texts the loss covers
    patch: int = 28  # an image's tokens: its started patches of so many pixels a side
    audio_rate: float = 25.0  # tokens of a second of audio
    page_tokens: int = 512  # tokens of a document's page

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close.strip(), *(f"<{k} " for k in ATTACHED))

    def escape(self, text: str, *more: str) -> str:
        return re.sub("|".join(["(?=" + re.escape(c) + ")" for c in (*self.controls, *more)] + [r"(?=\\)"]), r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


@dataclass
class Visitor:
    """Flattens the parts of one turn; number: of the conversation's last attachment so far."""

    template: Template
    number: int = 0
    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attached: list[dict] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def visit(self, part: dict, trained: bool) -> None:
        kind = part["kind"] or "text"
        if kind != "text":
            self.attach(kind if kind in ATTACHED else "attachment", part)
            return
        start = self.size
        self.put(self.template.escape(part["text"] or ""))
        if trained and self.size > start:
            self.spans.append((start, self.size))

    def attach(self, kind: str, part: dict) -> None:
        self.number += 1
        tokens = getattr(self, f"{kind}_tokens")(part)
        self.attached.append({"number": self.number, "kind": kind, "ref": part["ref"], "at": self.size, "tokens": tokens})
        self.put(f"<{kind} {self.number}>")

    def image_tokens(self, part: dict) -> int:
        return math.prod(max(1, math.ceil((part[side] or 0) / self.template.patch)) for side in ("width", "height"))

    def audio_tokens(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return max(1, math.ceil(seconds * self.template.audio_rate)) if math.isfinite(seconds) else 1

    def document_tokens(self, part: dict) -> int:
        return max(1, part["pages"] or 0) * self.template.page_tokens

    def attachment_tokens(self, part: dict) -> int:
        return 1


def segment(template: Template, role: str, parts: list[dict], number: int) -> Visitor:
    v = Visitor(template, number)
    v.put(template.open + template.escape(role, template.named[0]) + template.named)
    for p in parts:
        if p is not None:
            v.visit(p, role in template.trained)
    v.put(template.close)
    return v


def parse(template: Template, text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn of a formatted text; a part is ("text", unescaped text) or (kind, number)."""
    name_end = re.compile(rf"(?s)\\.|({re.escape(template.named)})")
    inside = re.compile(rf"(?s)\\.|({re.escape(template.close)})|<({'|'.join(ATTACHED)}) (\d+)>")
    at = 0
    while at < len(text):
        if not text.startswith(template.open, at):
            raise ValueError(f"no turn at {at}")
        start = at + len(template.open)
        end = next((m for m in name_end.finditer(text, start) if m[1]), None)
        if end is None:
            raise ValueError(f"a role at {start} doesn't end")
        role, parts, start = unescape(text[start : end.start()]), [], end.end()
        for m in inside.finditer(text, start):
            if m[1] is None and m[2] is None:
                continue
            if m.start() > start:
                parts.append(("text", unescape(text[start : m.start()])))
            start = m.end()
            if m[1] is not None:
                break
            parts.append((m[2], m[3]))
        else:
            raise ValueError(f"a turn at {at} doesn't end")
        yield role, parts
        at = start


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")))).cast(PARTS)


def _formatted(template: Template):
    longs = pa.int64()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    attached = pa.list_(pa.struct([("number", longs), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", longs)]))

    def run(batches):
        last, seq, number = object(), 0, 0
        for b in batches:
            out: dict[str, list] = {"seq": [], "segment": [], "loss": [], "attachments": [], "expanded_tokens": []}
            for conv, role, parts in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True):
                seq, number = (seq + 1, number) if conv == last else (0, 0)
                last = conv
                v = segment(template, role or "", parts or [], number)
                number = v.number
                out["seq"].append(seq)
                out["segment"].append("".join(v.pieces))
                out["loss"].append([{"start": s, "end": e} for s, e in v.spans])
                out["attachments"].append(v.attached)
                out["expanded_tokens"].append(sum(a["tokens"] for a in v.attached))
            kinds = (longs, pa.string(), span, attached, longs)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True))], names=["conv_id", *out])

    return run


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """turns: conv_id, turn, role, parts. Returns conv_id, seq, segment, loss, attachments, expanded_tokens.

    loss and an attachment's place (at) are in code points of the segment. Rows of a conversation are in
    one task, in order.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    names = "number:bigint,kind:string,ref:string,at:int,tokens:bigint"
    return dealt.mapInArrow(_formatted(template), f"conv_id {kind}, seq long, segment string, loss array<struct<start:int,end:int>>, attachments array<struct<{names}>>, expanded_tokens long")


def _digests(template: Template):
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        state, kind = None, None
        done: list[tuple] = []

        def end():
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def rows():
            conv, *rest = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv, kind), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names=["conv_id", *names])

        for b in batches:
            kind = b.column("conv_id").type
            for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        end()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, parts in parse(template, text):
                    state[1] += 1
                    said = "".join(t for k, t in parts if k == "text")
                    state[2].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learnt = unescape(text[s["start"] : s["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield rows()
        if state is not None:
            end()
            yield rows()

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the segments of format_conversations say when they are parsed, one row a conversation.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn, placeholders left out),
    loss_chars and loss_sha256 (of the unescaped text under the loss mask), formatted_chars. A hash goes
    through a conversation in order and holds a turn at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "segment", "loss").mapInArrow(_digests(template), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation of control strings, formatted along with the table's.
PLANTED = r"\### Assistant: </turn> ok"


def with_planted(spark: SparkSession, turns: DataFrame) -> DataFrame:
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").union(planted)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = with_planted(spark, table(spark, sf_dir, "conversations"))
    return read_back(format_conversations(turns.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))


OP13_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{PLANTED}'),
c AS (SELECT *, length(role) + len(regexp_extract_all(role, '\\|:|### |</turn>|<(image|audio|document|attachment) '))
  + length(text) + len(regexp_extract_all(text, '\\|### |</turn>|<(image|audio|document|attachment) ')) + 15 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
"""
