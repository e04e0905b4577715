"""Chat formatting with typed content parts.

A turn's content is a string or an array of parts `struct<type, text, ref, width, height, seconds, pages>`
(any of the fields after `type` may be missing). A visitor flattens the parts in order: text is escaped, and every
other part becomes one placeholder, with its reference and the number of tokens that a model expands it to.

The template of a turn is `<s>` role, newline, content, `</s>`. Every control string inside a role or a text, and
every escape character, gets an escape character before it, so the output can be read back without loss.

Defined cases: a null text or null content is empty; a null role is the empty role; an unknown part type is `file`
with no expanded tokens; a size that is null, negative, infinite or no number expands to no tokens, a broken one is rounded up; null conversation ids form one conversation; turns that tie are ordered by role and content;
repeated rows are turns of their own; an empty table gives an empty result; columns other than the four named ones
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPE = "\\"
#: Strings with a meaning to common chat templates, and this one's placeholders.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<image>", "<audio>", "<document>", "<file>")
_ESCAPED = re.compile("|".join(re.escape(x) for x in (ESCAPE, *CONTROLS)))
_TOKEN = re.compile(re.escape(ESCAPE) + "(?s:.)|" + "|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", ESCAPE + "\n")


def unescape(text: str) -> str:
    return re.sub(re.escape(ESCAPE) + "((?s:.))", lambda m: m[1], text)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a model gives to an attachment."""

    patch: int = 28
    audio_per_second: float = 25.0
    document_page: int = 1024


def _size(part: dict, name: str) -> float:
    """A size; nought where it is missing, negative, or no finite number."""
    size = part.get(name)
    return size if size is not None and math.isfinite(size) and size > 0 else 0


class PartVisitor:
    """Flattens the parts of one turn; a method for each type, `visit_other` for the rest."""

    def __init__(self, expansion: Expansion):
        self.expansion = expansion
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = self.expansion.patch
        self._place("image", part, math.ceil(_size(part, "width") / side) * math.ceil(_size(part, "height") / side))

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, math.ceil(_size(part, "seconds") * self.expansion.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, math.ceil(_size(part, "pages")) * self.expansion.document_page)

    def visit_other(self, part: dict) -> None:
        self._place("file", part, 0)

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.out.append(f"<{kind}>")


_ATTACHMENT = pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_TURN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", pa.list_(_ATTACHMENT)), ("expanded_tokens", pa.int64())])
TURN_DDL = "conv_id bigint, turn bigint, formatted string, loss_start int, loss_end int, attachments array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>, expanded_tokens bigint"


def format_turn(role: str, content, loss_roles: frozenset[str], expansion: Expansion) -> tuple[str, int, int, list[dict]]:
    """The turn's text, the span of it that counts for the loss (0, 0 where nothing does), its attachments."""
    visitor = PartVisitor(expansion)
    for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
        visitor.visit(part or {"type": "text"})
    head, body = f"<s>{escape_role(role)}\n", "".join(visitor.out)
    loss = (len(head), len(head) + len(body)) if role in loss_roles else (0, 0)
    return f"{head}{body}</s>", *loss, visitor.attachments


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",), expansion: Expansion = Expansion()) -> DataFrame:
    """A row for each turn with its part of the formatted conversation, in order within a partition, and each
    conversation whole in one partition. The turns stream through the task batch by batch; no conversation is held."""
    roles = frozenset(loss_roles)
    kind = df.schema[content_col].dataType
    content = F.col(content_col) if isinstance(kind, T.ArrayType) else F.col(content_col).cast("string")
    rows = df.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), content.alias("content"))
    order = "content" if isinstance(kind, T.StringType) else F.to_json(F.struct("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            out = [format_turn(r, c, roles, expansion) for r, c in zip(x["role"], x["content"], strict=True)]
            yield pa.RecordBatch.from_pydict({"conv_id": x["conv_id"], "turn": x["turn"], "formatted": [o[0] for o in out], "loss_start": [o[1] for o in out], "loss_end": [o[2] for o in out], "attachments": [o[3] for o in out], "expanded_tokens": [sum(a["tokens"] for a in o[3]) for o in out]}, schema=_TURN)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", order).mapInArrow(run, TURN_DDL)


def parse_turns(formatted: str) -> Iterator[tuple[str, str, int]]:
    """(role, text, place of the text in `formatted`) of each turn; the inverse of the template, placeholders stay."""
    start = newline = None
    for m in _TOKEN.finditer(formatted):
        if m[0] == "<s>":
            start, newline = m.end(), None
        elif m[0] == "</s>" and start is not None:
            newline = _role_end(formatted, start)
            yield unescape(formatted[start:newline]), unescape(formatted[newline + 1 : m.start()]), newline + 1
            start = None


def _role_end(formatted: str, at: int) -> int:
    while formatted[at] != "\n":
        at += 2 if formatted[at] == ESCAPE else 1
    return at


class _Digest:
    """What is known of a conversation after the turns read so far."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss_start: int, loss_end: int) -> None:
        self.chars += len(formatted)
        for role, text, _ in parse_turns(formatted):
            self.turns += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_end > loss_start:
            under = unescape(formatted[loss_start:loss_end])
            self.loss_chars += len(under)
            self.loss_sha.update(under.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of what `format_conversations` gave, read from the formatted text itself."""

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = list(zip(*(d.row() for d in done), strict=True)) or [[]] * len(_DIGEST)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv_id, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now] if now else []
                    now = _Digest(conv_id)
                now.add(text, start, end)
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
