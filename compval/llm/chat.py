r"""Chat formatting with a grammar that reads its own output back.

    conversation = { turn }
    turn         = "### " role ": " body "</turn>" newline

A backslash makes the next character ordinary; a body ends at the first `</turn>` and a role at the first `: ` that no
backslash touches. A turn is rendered as it stands and parsed; where the parse differs from the source, its control
strings and backslashes are escaped, and the result is parsed again. So clean text stays as it is, and whatever text
holds, the recovered turns equal the source.

Null texts and roles are empty. Rows of a conversation go by turn (null first), then by their formatted text; repeated
rows are turns of their own. A null conv_id is a conversation of its own. Other columns are ignored. An empty table
gives no rows. Conversations are digested as a sorted stream, a turn at a time, however long they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import rows_out

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
_CONTROL = re.compile(r"\\|#(?=## )|:(?= )|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
# Possessive, so that a long text takes no memory to go back through.
_ROLE = re.compile(r"(?:[^\\:]++|\\.|:(?! ))*+", re.S)
_BODY = re.compile(r"(?:[^\\<]++|\\.|<(?!/turn>))*+", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted conversation: role, text, and where its body starts and ends. Raises ValueError."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        role = _ROLE.match(formatted, at + len(OPEN))
        if not formatted.startswith(COLON, role.end()):
            raise ValueError(f"a role without end at {at}")
        body = _BODY.match(formatted, role.end() + len(COLON))
        if not formatted.startswith(CLOSE + "\n", body.end()):
            raise ValueError(f"a turn without end at {at}")
        out.append((unescape(role[0]), unescape(body[0]), body.start(), body.end()))
        at = body.end() + len(CLOSE) + 1
    return out


def render(role: str, text: str) -> str:
    """A turn that parses to exactly this role and text."""
    for form in (lambda x: x, escape):
        out = f"{OPEN}{form(role)}{COLON}{form(text)}{CLOSE}\n"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn that the grammar can't hold")


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("body_start", pa.int64()), ("body_end", pa.int64()), ("loss", pa.bool_())])


def format_turns(conversations: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn's formatted text, its body in code points (end exclusive), and whether the loss counts it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                out = render(role, text)
                (_, _, start, end) = parse(out)[0]
                rows.append((conv, turn, out, start, end, role in learnt))
            yield rows_out(TURNS, rows)

    rows = conversations.select(
        *(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    return rows.mapInArrow(run, "conv_id long, turn long, formatted string, body_start long, body_end long, loss boolean")


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(turns: DataFrame) -> DataFrame:
    """What each conversation says when its formatted turns are read back, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n = None, 0
        for b in batches:
            rows = []
            for key, out, start, end, loss in zip(*(c.to_pylist() for c in b.columns)):
                if not n or key != conv:
                    if n:
                        rows.append((conv, n, every.hexdigest(), chars, learnt.hexdigest(), length))
                    conv, n, chars, length, every, learnt = key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in parse(out):
                    n += 1
                    every.update(f"{role}\n{text}\n".encode())
                length += len(out)
                if loss:
                    text = unescape(out[start:end])
                    chars += len(text)
                    learnt.update(text.encode())
            yield rows_out(DIGESTS, rows)
        if n:
            yield rows_out(DIGESTS, [(conv, n, every.hexdigest(), chars, learnt.hexdigest(), length)])

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return dealt.select("conv_id", "formatted", "body_start", "body_end", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
