"""Chat formatting with typed content parts.

A turn's content is a list of parts of type text, image, audio or document. A visitor flattens them, in order, into one
string: text as it is, every other part as a placeholder ``<|type:k|>`` (k counts the conversation's attachments), for which
it records the reference and how many tokens the part expands to. The template marks turns as

    <|turn|>role<|body|>content<|end|>

and escapes control strings inside roles and texts (adjacent text parts are one text, so a control string can't be put together
from several of them): one backslash goes between a control string's first character and the
rest, after any that are there already, so unescaping takes exactly one away and gives the input back. Control strings are
those of this template (placeholders too) and the common ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>`` ones. So what is
unescaped is the template's own: a placeholder that somebody types reads back as text, a real one as an attachment.
References do not enter the string; they are recorded as they are.

The loss mask holds the places (code points, end exclusive) of the assistants' contents in the formatted string.

Defined results: rows are ordered by turn (null first), then role and text; null text is a text without characters, a null
role an empty role; rows without a conversation id can't be told apart from each other's conversations, so each is one of
its own; repeated rows are turns of their own; other columns are left out; a part without a type is a text; a part of an unknown
type gets the placeholder ``<|other:k|>`` and no tokens, and is recorded with the type it has.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
LOSS_ROLE = "assistant"
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _TAIL)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|other):[0-9]+\|>")
_FORMATTED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_TYPE = f"struct<turn:bigint,role:string,parts:array<{PART}>>"
OUT = "formatted string, n_turns long, loss array<struct<start:long,end:long>>, attachments array<struct<turn:long,part:long,type:string,placeholder:string,ref:string,tokens:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@dataclass
class Flattener:
    """Visits a conversation's parts in order; collects the string's pieces and the attachments."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 512
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    waiting: list[str] = field(default_factory=list)
    size: int = 0

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def flush(self) -> None:
        """Writes the text parts since the last attachment, escaped as one text."""
        if self.waiting:
            self.put(escape("".join(self.waiting)))
            self.waiting.clear()

    def visit(self, part: dict, turn: int, at: int) -> None:
        kind = part["type"] or "text"
        known = kind in ("text", "image", "audio", "document")
        tokens = getattr(self, f"visit_{kind}" if known else "visit_other")(part)
        if tokens is not None:
            self.flush()
            mark = f"<|{kind if known else 'other'}:{len(self.attachments)}|>"
            self.attachments.append({"turn": turn, "part": at, "type": kind, "placeholder": mark, "ref": part["ref"], "tokens": tokens})
            self.put(mark)

    def visit_text(self, part: dict) -> None:
        self.waiting.append(part["text"] or "")

    def visit_image(self, part: dict) -> int:
        return math.ceil((part["width"] or 0) / self.patch) * math.ceil((part["height"] or 0) / self.patch)

    def visit_audio(self, part: dict) -> int:
        return math.ceil((part["seconds"] or 0) * self.audio_rate)

    def visit_document(self, part: dict) -> int:
        return (part["pages"] or 0) * self.page_tokens

    def visit_other(self, part: dict) -> int:
        return 0


def render(turns: list[dict]) -> dict:
    """One conversation, formatted."""
    out, loss = Flattener(), []
    for k, turn in enumerate(turns):
        role = turn["role"] or ""
        out.put(f"{TURN}{escape(role)}{BODY}")
        start = out.size
        for i, part in enumerate(turn["parts"] or []):
            out.visit(part, k, i)
        out.flush()
        if role == LOSS_ROLE:
            loss.append({"start": start, "end": out.size})
        out.put(END)
    return {"formatted": "".join(out.pieces), "n_turns": len(turns), "loss": loss, "attachments": out.attachments}


def said(content: str) -> str:
    """The text of a formatted content: without placeholders, unescaped."""
    return "".join(map(unescape, _PLACEHOLDER.split(content)))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation, unescaped, without placeholders."""
    return [(unescape(a), said(b)) for a, b in _FORMATTED.findall(formatted)]


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(conv_id, turns) from a row a turn: its text, and then its other parts (an array of ``PART``) if ``parts_col`` is given."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    parts = F.array(part).cast(f"array<{PART}>")
    if parts_col:
        parts = F.concat(parts, F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")))
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    own = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("turn"))
    known = own.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return known.unionByName(own.filter("conv_id is null").select("conv_id", F.array("turn").alias("turns")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss, attachments) from (conv_id, turns: array<TURN_TYPE>)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(x or []) for x in batch.column("turns").to_pylist()]
            new = [pa.array([x[f.name] for x in done], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *new], names=["conv_id", *schema.names])

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    found = pa.struct([("turn", pa.int64()), ("part", pa.int64()), ("type", pa.string()), ("placeholder", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    schema = pa.schema([("formatted", pa.string()), ("n_turns", pa.int64()), ("loss", pa.list_(span)), ("attachments", pa.list_(found))])
    return conversations.select("conv_id", "turns").filter("turns is not null").mapInArrow(run, f"conv_id {kind}, {OUT}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say: turns and text under the loss mask. Other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                learnt = "".join(said(text[x["start"] : x["end"]]) for x in loss)
                told = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            new = dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), (pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *new.values()], names=[*rest, *new])

    rest = [c for c in formatted.columns if c not in ("formatted", "loss", "n_turns")]
    own = formatted.select(*rest, "formatted", "loss")
    kinds_ = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in rest)
    return own.mapInArrow(run, f"{kinds_}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def attached(rows: DataFrame) -> DataFrame:
    """rows with ``parts``: what a conversation's turns carry here. The tables name no files, so every user's turn gets one
    attachment, a picture, a recording or a document by its turn, as large as its text is long."""
    n = F.length(F.coalesce("text", F.lit("")))
    kind = F.element_at(F.array(*map(F.lit, ("image", "audio", "document"))), (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(3)) + 1).cast("int"))
    own = F.col("kind")
    part = F.struct(
        own.alias("type"), F.lit(None).cast("string").alias("text"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("ref"),
        F.when(own == "image", n + 1).alias("width"), F.when(own == "image", F.lit(29)).alias("height"), F.when(own == "audio", n / 10).alias("seconds"), F.when(own == "document", n % 7).alias("pages"),
    )
    return rows.withColumn("kind", kind).withColumn("parts", F.when(F.col("role") == "user", F.array(part).cast(f"array<{PART}>"))).drop("kind")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every conversation formatted, with attachments, and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    formatted = format_conversations(turns_of(attached(rows.unionByName(extra)), parts_col="parts"))
    told = F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["type"], a["ref"], a["tokens"].cast("string"))), ",")
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    counted = formatted.select("conv_id", "formatted", "loss", F.size("attachments").cast("long").alias("n_attachments"), tokens.alias("attachment_tokens"), F.sha2(told, 256).alias("attachments_sha256"))
    return read_back(counted)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
a AS (
  SELECT *, CASE WHEN role = 'user' THEN ['image', 'audio', 'document'][((coalesce(turn, 0) % 3 + 3) % 3)::INT + 1] END AS kind,
    CASE WHEN role = 'user' THEN CASE ((coalesce(turn, 0) % 3 + 3) % 3) WHEN 0 THEN ceil((length(text) + 1) / 14.0) * 3 WHEN 1 THEN ceil(length(text) / 10.0::DOUBLE * 25) ELSE length(text) % 7 * 512 END END::BIGINT AS tokens
  FROM c),
k AS (SELECT *, CASE WHEN kind IS NOT NULL THEN count(kind) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - 1 END AS place FROM a),
t AS (
  SELECT *, length(role) + length(text) + 23 + coalesce(length(kind) + length(place::VARCHAR) + 5, 0)
    + len(regexp_extract_all(role, '<\\*\||<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) + len(regexp_extract_all(text, '<\\*\||<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>')) AS size
  FROM k)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars, count(kind)::BIGINT AS n_attachments, coalesce(sum(tokens), 0)::BIGINT AS attachment_tokens,
  sha256(coalesce(string_agg(kind || ':' || concat_ws('/', conv_id, turn) || ':' || tokens, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (kind IS NOT NULL), '')) AS attachments_sha256
FROM t GROUP BY conv_id
"""
