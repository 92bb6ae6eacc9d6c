"""Chat formatting with typed content parts (operator 10).

A turn is a role and an ordered list of parts: text, image, audio or document.  A
visitor flattens the parts: text is escaped, every other part becomes a numbered
placeholder, and its attachment is recorded with the number of tokens that it expands
to.  Each turn becomes one segment of the formatted conversation:

    <|turn|>role<|says|>parts<|done|>

Control strings inside texts and roles are escaped reversibly: a backslash is doubled,
and a backslash goes behind the first character of whatever would read as a control
string.  The loss mask marks the texts of assistant turns, in code points of a segment.

A conversation is never gathered: segments are rows, ordered by turn, and the digests
of `op10_chat_formats` are taken while sorted rows stream by."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.shipping import ship_package

#: The marks of the template.
TURN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
# Control strings of common chat templates, which may not stand in a text as they are.
CONTROLS = (TURN, SAYS, DONE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|system|>", "<|user|>", "<|assistant|>")
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a document page.
EXPANDS = {"image": 256, "audio": 25, "document": 512}
LEARNED = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"
SEGMENTS = "conv_id long, turn long, segment string, loss array<struct<start:int,end:int>>, attachments array<struct<place:int,type:string,ref:string,tokens:bigint>>, expanded_tokens long"
FORMATS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPED = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROLS) + r"|\|(?:image|audio|document):)")
_PLAIN = re.compile(r"\\(\\?)")
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(DONE), re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document):\d+\|>")


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _PLAIN.sub(lambda m: m[1], text)


class Visitor:
    """Flattens the parts of one turn, in order."""

    def __init__(self):
        self.out, self.size, self.texts, self.attachments = [], 0, [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        text = escaped(part.get("text") or "")
        self.texts.append((self.size, self.size + len(text)))
        self._add(text)

    def _attached(self, part: dict) -> None:
        kind = part["type"]
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"), "tokens": EXPANDS[kind] * max(part.get("units") or 0, 0)})
        self._add(f"<|{kind}:{len(self.attachments) - 1}|>")

    visit_image = visit_audio = visit_document = _attached

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part {part.get('type')!r}")

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def segment(role: str | None, parts: list[dict]) -> tuple[str, list[dict], list[dict], int]:
    """The formatted turn, its loss spans, its attachments and the tokens these expand to."""
    head = TURN + escaped(role or "") + SAYS
    seen = Visitor()
    for part in parts:
        seen.visit(part)
    spans = [{"start": len(head) + a, "end": len(head) + b} for a, b in seen.texts if b > a] if role == LEARNED else []
    return head + "".join(seen.out) + DONE, spans, seen.attachments, sum(a["tokens"] for a in seen.attachments)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns; placeholders are left out."""
    for m in _READ.finditer(formatted):
        yield unescaped(m[1]), unescaped(_PLACE.sub("", m[2]))


def formatted(turns: DataFrame) -> DataFrame:
    """One segment a row of (conv_id, turn, role, text or parts).

    Defined results: where `parts` is there and not null it counts, otherwise the text is
    the only part; a null text or role is empty; null ids and turns stay as they are and
    sort first; rows with equal turns are ordered by role, then text; an unknown part type
    is an error; other columns are ignored; an empty table gives an empty result."""
    ship_package(turns.sparkSession)
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    text = F.col("text").cast("string") if "text" in turns.columns else F.lit(None).cast("string")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), parts.alias("parts"))
    # the order of a conversation is settled before its rows are formatted, as segments do not sort like texts
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = pa.struct([("start", pa.int32()), ("end", pa.int32())]), pa.struct([("place", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])

    def each(batches):
        for batch in batches:
            made = [segment(role, [{"type": "text", "text": text}] if parts is None else parts) for role, text, parts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            if made:
                texts, loss, attached, tokens = zip(*made)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(loss, pa.list_(kinds[0])), pa.array(attached, pa.list_(kinds[1])), pa.array(tokens, pa.int64())], [c.split()[0] for c in ("conv_id", "turn", "segment", "loss", "attachments", "expanded_tokens")])

    return rows.mapInArrow(each, SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: counts and digests of turns and of the text under the mask.

    The segments must come as `formatted` orders them."""

    def each(batches):
        names = [c.split()[0] for c in FORMATS.split(", ")]
        now, state = None, None

        def row():
            return now[0], state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]

        for batch in batches:
            rows = []
            for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(row())
                    now, state = (conv,), {"turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                for role, said in read_back(text):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                state["chars"] += len(text)
                for span in loss:
                    masked = unescaped(text[span["start"] : span["end"]])
                    state["loss"] += len(masked)
                    state["masked"].update(masked.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(row()), _KINDS)], names)

    return segments.mapInArrow(each, FORMATS)


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def op10_chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(formatted(given.unionByName(own)))
