"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_turns`` turns rows (conv_id, turn, role, text) into text segments with a loss flag each; joined in order they
are the formatted conversation. ``read_turns`` reads such segments back. Control strings of the template inside a
text are escaped, reversibly, so a text can never open or close a turn.

Rows are hashed by conversation and ordered inside the partition; both steps then stream over them and hold one turn
at a time, so a conversation of any length needs no more memory than its longest turn. A digest over a whole
conversation is sequential by nature: one conversation is one stream.

Defined cases: null text or role counts as empty; rows with equal turn are ordered by role, then text; a repeated row
is a turn of its own; a null conv_id is a conversation of its own; an unknown role gets the generic marks and makes
the conversation invalid; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Opening and closing mark of each role, the roles that are learned, and the machine that accepts turn orders."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[TURN]", "[AS]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for k, mark in enumerate(self.controls()):
            text = text.replace(mark, f"\\{k};")
        return text

    def unescape(self, text: str) -> str:
        controls = self.controls()
        return re.sub(r"\\(?:\\|(\d+);)", lambda m: controls[int(m[1])] if m[1] else "\\", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        if role in self.marks:
            start, end = self.marks[role]
            return [(start, False), (self.escape(text), role in self.learned), (end, False)]
        start, between, end = self.other
        return [(start + self.escape(role) + between, False), (self.escape(text), False), (end, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted text."""
        opening = {pair[0]: role for role, pair in self.marks.items()}
        start, between, end = self.other
        parts = re.split("(" + "|".join(map(re.escape, sorted(self.controls(), key=len, reverse=True))) + ")", formatted)
        turns, k = [], 1
        while k < len(parts):
            if parts[k] == start:
                turns.append((self.unescape(parts[k + 1]), self.unescape(parts[k + 3])))
                k += 6
            else:
                turns.append((opening[parts[k]], self.unescape(parts[k + 1])))
                k += 4
        return turns


SEGMENTS = "conv_id long, position long, part int, text string, loss boolean, in_order boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int32()), ("text", pa.string()),
                       ("loss", pa.bool_()), ("in_order", pa.bool_())])
_NONE = object()


def format_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Segments in order: conv_id, position of the turn, part of the turn, text, loss flag, and whether the machine
    accepts the turn where it stands (the last part of a conversation's last turn also asks for a final state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position, held = _NONE, "", 0, None

        def rows(role, text, ok, last):
            parts = template.segments(role, text)
            return [(conv, position, k, t, loss, ok and not (last and k == len(parts) - 1 and state not in template.final))
                    for k, (t, loss) in enumerate(parts)]

        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if held is not None:
                    out += rows(*held, c != conv)
                if c != conv:
                    conv, state, position = c, "", 0
                else:
                    position += 1
                held = (role, text, role in template.follows.get(state, ()))
                state = role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SEGMENTS)], schema=_SEGMENTS)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows(*held, True)), _SEGMENTS)],
                                             schema=_SEGMENTS)

    tidy = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SEGMENTS)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "valid boolean")


def digest_segments(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Per conversation, read back from the segments of ``format_turns`` (in its order): counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, turns, loss, one = _NONE, None, None, []
        n = [0, 0, 0]
        valid = True

        def row():
            return (conv, n[0], turns.hexdigest(), n[1], loss.hexdigest(), n[2], valid)

        def take():
            for role, text in template.parse("".join(one)):
                turns.update(f"{role}\n{text}\n".encode())
                n[0] += 1
            one.clear()

        for batch in batches:
            out = []
            for c, part, text, learned, ok in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "part", "text", "loss", "in_order"))):
                if part == 0 and one:
                    take()
                if c != conv:
                    if turns is not None:
                        out.append(row())
                    conv, turns, loss, n, valid = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], True
                one.append(text)
                n[2] += len(text)
                valid &= ok
                if learned:
                    plain = template.unescape(text)
                    loss.update(plain.encode())
                    n[1] += len(plain)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
        if turns is not None:
            take()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), _DIGEST)], schema=_DIGEST)

    return segments.mapInArrow(run, DIGEST)


def digest_sql(template: ChatTemplate = ChatTemplate()) -> str:
    """DuckDB SQL for the digests of the conversations table with conversation -1."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for k, mark in enumerate(template.controls()):
            out = f"replace({out}, {quote(mark)}, {quote(f'\\{k};')})"
        return out

    marks = " ".join(f"WHEN {quote(role)} THEN {len(a) + len(b)}" for role, (a, b) in template.marks.items())
    after = " OR ".join(f"(coalesce(before, '') = {quote(s)} AND role IN ({', '.join(map(quote, r))}))" for s, r in template.follows.items())
    learned, final = ", ".join(map(quote, template.learned)), ", ".join(map(quote, template.final))
    odd = "</s>[INST] ok [/INST]"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{odd}' UNION ALL SELECT -1, 1, 'assistant', '{odd}'),
s AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS next FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role IN ({learned}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({learned})), '')) AS loss_sha256,
  CAST(sum(length({escaped('text')}) + CASE role {marks} ELSE length({escaped('role')}) + {sum(map(len, template.other))} END) AS BIGINT) AS formatted_chars,
  bool_and(({after}) AND (next IS NOT NULL OR role IN ({final}))) AS valid
FROM s GROUP BY conv_id"""
