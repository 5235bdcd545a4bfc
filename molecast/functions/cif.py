"""Dictionary files: tokens, tables, values and writing."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

#: Kinds of value: plain text, quoted text, unknown (?), inapplicable (.).
PLAIN, QUOTED, UNKNOWN, INAPPLICABLE = range(4)
KEYWORD = re.compile(r"(?i)(data_|save_|loop_$|global_$|stop_$)")
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?(\(\d+\))?")
TOKEN = re.compile(r"[^\s]+")
Value = tuple[str, int]


class CifError(ValueError):
    """The text isn't a valid dictionary file."""


@dataclass
class Frame:
    """Named tables: keys, and rows of (text, kind)."""

    name: str = ""
    tables: list[tuple[list[str], list[list[Value]]]] = field(default_factory=list)
    saves: list[Frame] = field(default_factory=list)
    is_global: bool = False


def tokens(text: str):
    """(kind, text): word, value or text field; comments go. Quotes close only before white space."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        line = lines[i]
        if line.startswith(";"):
            body, start = [line[1:]], i
            i += 1
            while i < len(lines) and not lines[i].startswith(";"):
                body.append(lines[i])
                i += 1
            if i == len(lines):
                raise CifError(f"the text field of line {start + 1} isn't closed")
            yield "text", _unfold(body)
            line = " " + lines[i][1:]
        at = 0
        while got := TOKEN.search(line, at):
            c, at = got[0][0], got.start()
            if c == "#":
                break
            if c in "'\"":
                end = re.compile(c + r"(?=\s|$)").search(line, at + 1)
                if not end:
                    raise CifError(f"the quote of line {i + 1} isn't closed")
                yield "text", line[at + 1 : end.start()]
                at = end.end()
            else:
                yield "word", got[0]
                at = got.end()
        i += 1


def _unfold(body: list[str]) -> str:
    """A text field whose first line ends in a backslash is folded: such lines go on in the next one."""
    if not body[0].rstrip().endswith("\\"):
        return "\n".join(body)
    head, out, on = body[0].rstrip()[:-1], [], False
    for line in ([head] if head else []) + body[1:]:
        cutoff = line.rstrip().endswith("\\")
        piece = line.rstrip()[:-1] if cutoff else line
        out = [*out[:-1], out[-1] + piece] if on else [*out, piece]
        on = cutoff
    return "\n".join(out)


def _value(kind: str, text: str) -> Value:
    if kind == "text":
        return text, QUOTED
    return text, {"?": UNKNOWN, ".": INAPPLICABLE}.get(text, PLAIN)


def read_blocks(text: str) -> list[Frame]:
    """The data blocks of a file, with their save frames."""
    blocks: list[Frame] = []
    at: Frame | None = None
    stream = list(tokens(text))
    i, pairs = 0, None
    while i < len(stream):
        kind, word = stream[i]
        low = word.lower() if kind == "word" else ""
        if low.startswith("data_") or low == "global_":
            if at is not None and blocks and at is not blocks[-1]:
                raise CifError("a save frame isn't closed")
            at = Frame("" if low == "global_" else word[5:], is_global=low == "global_")
            blocks.append(at)
            pairs = None
        elif low.startswith("save_"):
            if at is None:
                raise CifError("a save frame is outside of a block")
            if len(word) == 5:
                if at is blocks[-1]:
                    raise CifError("a save frame ends that didn't start")
                at = blocks[-1]
            else:
                if at is not blocks[-1]:
                    raise CifError("save frames can't be nested")
                at = Frame(word[5:])
                blocks[-1].saves.append(at)
            pairs = None
        elif low == "stop_":
            pass
        elif at is None:
            raise CifError(f"{word} is outside of a block")
        elif low == "loop_":
            keys, values, i = [], [], i + 1
            while i < len(stream) and stream[i][0] == "word" and stream[i][1].startswith("_"):
                keys.append(stream[i][1])
                i += 1
            while i < len(stream) and not (stream[i][0] == "word" and (stream[i][1].startswith("_") or KEYWORD.match(stream[i][1]))):
                values.append(_value(*stream[i]))
                i += 1
            if not keys or len(values) % len(keys):
                raise CifError("a loop has an inconsistent number of values")
            at.tables.append((keys, [values[k : k + len(keys)] for k in range(0, len(values), len(keys))]))
            pairs = None
            continue
        elif kind == "word" and word.startswith("_"):
            if i + 1 == len(stream) or stream[i + 1][0] == "word" and (stream[i + 1][1].startswith("_") or KEYWORD.match(stream[i + 1][1])):
                raise CifError(f"{word} has no value")
            prefix = word.split(".")[0]
            if pairs is None or pairs[0] != prefix:
                pairs = (prefix, ([], [[]]))
                at.tables.append(pairs[1])
            pairs[1][0].append(word)
            pairs[1][1][0].append(_value(*stream[i + 1]))
            i += 1
        else:
            raise CifError(f"{word} isn't expected")
        i += 1
    if at is not None and at is not blocks[-1]:
        raise CifError("a save frame isn't closed")
    return blocks


def long_rows(text: str):
    """(block, frame, table_idx, row_idx, key, value, value_type) of a file."""
    for block in read_blocks(text):
        for frame in (block, *block.saves):
            for t, (keys, rows) in enumerate(frame.tables):
                for r, row in enumerate(rows):
                    for key, (value, kind) in zip(keys, row, strict=True):
                        yield block.name, "" if frame is block else frame.name, t, r, key, value, kind


def validate(frame: Frame) -> str | None:
    """What is wrong with a frame's keys and rows, or None."""
    seen: set[str] = set()
    for keys, rows in frame.tables:
        for key in keys:
            if not re.fullmatch(r"_[\x21-\x7e]+", key):
                return f"{key!r} isn't a key"
            if key in seen:
                return f"{key} comes twice"
            seen.add(key)
        if any(len(row) != len(keys) for row in rows):
            return "rows differ in length"
    return None


def format_value(value, width: int = 0, precision: int | None = None, raw: bool = False, short: bool = False, null: str = "?", coerce: bool = False) -> str:
    """A scalar as a file spells it."""
    if value is None:
        return null
    if isinstance(value, bool):
        return ("y" if value else "n") if short else ("yes" if value else "no")
    if isinstance(value, int):
        return f"{value:0{width}d}"
    if isinstance(value, float):
        if not math.isfinite(value):
            if not coerce:
                raise ValueError("a number must be finite")
            return null if math.isnan(value) else f"{'-' if value < 0 else ''}8e+88888888"
        return f"{value:.{precision}f}" if precision is not None else repr(value)
    return str(value) if raw else quote(str(value))


def quote(text: str) -> str:
    """A text with the quotes that it needs to be read back as text."""
    if text == "":
        return "''"
    single, double = bool(re.search(r"'(?=\s)", text)), bool(re.search(r'"(?=\s)', text))
    if "\n" in text or single and double:
        if "\n;" in text:
            raise ValueError("a line of a text field can't start with a semicolon")
        return f"\n;{text}\n;"
    bare = not re.search(r"\s", text) and text[0] not in "_#$'\"[];" and text not in "?." and not KEYWORD.match(text) and not NUMBER.fullmatch(text)
    if bare:
        return text
    return f'"{text}"' if "'" in text and not double else f"'{text}'" if not single else f'"{text}"'


def write(frame: Frame, align: bool = False) -> str:
    """A block as text: pairs for tables of one row, loops for others, save frames after them; empty tables are left out."""
    out = ["global_" if frame.is_global else f"data_{frame.name}"]
    for part in (frame, *frame.saves):
        if part is not frame:
            out.append(f"save_{part.name}")
        for keys, rows in part.tables:
            cells = [[v if kind == PLAIN else "?" if kind == UNKNOWN else "." if kind == INAPPLICABLE else quote(v) for v, kind in row] for row in rows]
            if len(cells) == 1:
                wide = max(map(len, keys)) if align else 0
                out += [f"{k:<{wide}} {v}" if not v.startswith("\n") else f"{k}{v}" for k, v in zip(keys, cells[0], strict=True)]
            elif cells:
                out += ["loop_", *keys]
                wide = [max(len(r[i]) for r in cells) if align else 0 for i in range(len(keys))]
                for row in cells:
                    line = ""
                    for v, w in zip(row, wide, strict=True):
                        line += v + "\n" if v.startswith("\n") else f"{v:<{w}} "
                    out.append(line.rstrip())
        if part is not frame:
            out.append("save_")
    return "\n".join(out) + "\n"
