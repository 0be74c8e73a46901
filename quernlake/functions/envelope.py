"""Envelopes of messages: wrappers, marks, spacing, quotes and media descriptions, read by one scan with a stack.

The scans run in Arrow batches; names that keep their blanks are found by an automaton that each task builds once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cleaning as C

# Tags of wrappers, those that become a mark with what stands around it, and CJK letters.
DROPPED = ("msg", "forward", "quote", "message")
MARKS = {"reply": ("↩", ""), "at": ("@", ""), "sticker": ("[表情", "]"), "image": ("[图片", "]")}
CJK = "㐀-䶿一-鿿豈-﫿"
MARK = r"(?:↩[^\s<]*|@[^\s<]*|\[(?:表情|图片)[^\]]*\])"
# How a quoted message begins, a time before it, media, and where a description ends.
REPLY_HEAD = r"\[Reply ID:\s*(-?\d+)\s*content:\s*"
TIME_HEAD = r"^\[?\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}[ T]\d{1,2}:\d{2}(?::\d{2})?\s*\]?\s*"
MEDIA_HEAD = rf"\[({C.MEDIA_WORDS})\s+"
FILE_TAIL = r",\s*file_path:"

TAG = re.compile(rf"<\s*(/?)\s*({'|'.join([*DROPPED, 'text', *MARKS])})\b([^>\n]*?)>", re.I)
THINK = re.compile(r"<\s*(/?)\s*(reasoning|msg)\b([^>\n]*?)>|<\s*msg\b", re.I)
ONLY_MARKS = re.compile(rf"[ \t]*(?:{MARK}[ \t]*)*")
HEAD = re.compile(f"(?P<reply>{REPLY_HEAD})|(?P<media>{MEDIA_HEAD})", re.I)
REPLY = re.compile(REPLY_HEAD)
SPACED = re.compile(rf"[{CJK}](?:[ \t]+[{CJK}]){{2,}}")
BETWEEN = re.compile(rf"(?<=[{CJK}])[ \t]+(?=[{CJK}])")
BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd]")


def _cut(text: str, limit: int) -> str:
    text = text.strip()
    return text[:limit].rstrip() + "…" if limit and len(text) > limit else text


def without_reasoning(text: str) -> str:
    """Without reasoning blocks. A closed one goes whole; an open one up to the next message, or if none follows its tag alone."""
    if "<" not in text:
        return text
    out, at, opened = [], 0, None
    for m in THINK.finditer(text):
        closes, name, rest = m.group(1), (m.group(2) or "msg").lower(), m.group(3) or ""
        if name == "reasoning" and not closes and opened is None and not (rest.endswith("/") and not _closed(text, m.end())):
            opened = m
        elif name == "reasoning" and closes and opened is not None:
            out.append(text[at : opened.start()])
            at, opened = m.end(), None
    whole = "".join(out) + text[at:]
    while (m := next((x for x in THINK.finditer(whole) if (x.group(2) or "").lower() == "reasoning" and not x.group(1)), None)) is not None:
        following = next((x for x in THINK.finditer(whole, m.end()) if (x.group(2) or "msg").lower() == "msg" and not x.group(1)), None)
        if following is None:
            break
        whole = whole[: m.start()] + whole[following.start() :]
    return THINK.sub(lambda m: "" if (m.group(2) or "").lower() == "reasoning" else m.group(0), whole)


def _closed(text: str, at: int) -> bool:
    return any(x.group(1) and (x.group(2) or "").lower() == "reasoning" for x in THINK.finditer(text, at))


def _marked(text: str) -> list[tuple[str, str]]:
    """The text as pieces ("", text), ("open", raw) and ("close", raw) of text tags; all other tags are gone.

    A tag of a mark with its closing one, without tags or line ends between, becomes the mark; a message's end a line end.
    """
    out: list[tuple[str, str]] = []
    at = 0
    tags = list(TAG.finditer(text))
    k = 0
    while k < len(tags):
        m = tags[k]
        closes, name, rest = m.group(1), m.group(2).lower(), m.group(3)
        out.append(("", text[at : m.start()]))
        at = m.end()
        then = tags[k + 1] if k + 1 < len(tags) else None
        between = text[at : then.start()] if then else ""
        if name in MARKS and m.group(0).lower() == f"<{name}>" and then and then.group(0).lower() == f"</{name}>" and "<" not in between and "\n" not in between:
            before, after = MARKS[name]
            out.append(("", before + between.strip() + after))
            at, k = then.end(), k + 1
        elif name == "msg" and closes:
            out.append(("", "\n"))
        elif name == "text" and not closes and rest.rstrip().endswith("/"):
            pass
        elif name == "text" and not closes and then and then.group(2).lower() == "text" and then.group(1) and not between.strip():
            at, k = then.end(), k + 1
        elif name == "text":
            out.append(("close" if closes else "open", m.group(0)))
        k += 1
    out.append(("", text[at:]))
    return out


def unwrapped(text: str) -> str:
    """Without the wrappers of messages; marks and line ends between messages stay, and tags that prose speaks of.

    A text tag is a wrapper if nothing but marks stands before it in its line, and nothing but marks follows the closing
    one in its line, or another tag. What stands between is kept to the letter.
    """
    if "<" not in text:
        return text
    pieces = _marked(text)
    follows = [""] * (len(pieces) + 1)  # what the rest begins with, its first line at most
    for k in range(len(pieces) - 1, -1, -1):
        kind, s = pieces[k]
        follows[k] = "<" if kind else s if "\n" in s or "<" in s else s + follows[k + 1]
    out: list[str] = []
    line = ""  # of the output, from the last line end that isn't a wrapper's
    opened: list[tuple[int, bool]] = []  # place in out, and whether its line was blank before it
    for k, (kind, s) in enumerate(pieces):
        if not kind:
            out.append(s)
            line = s.rpartition("\n")[2] if "\n" in s else line + s
        elif kind == "open" and ONLY_MARKS.fullmatch(line):
            opened.append((len(out), not line.strip()))
            out.append(s)
        elif kind == "close" and opened and re.match(r"[ \t]*(?:\n|<|\Z)", follows[k + 1][ONLY_MARKS.match(follows[k + 1]).end() :]):
            place, blank = opened.pop()
            out[place] = "\n" if blank else ""
        else:
            out.append(s)
            line += s
    return "".join(out)


@lru_cache(4)
def _automaton(names: tuple[str, ...]) -> ahocorasick.Automaton | None:
    spaced = {n for n in names if n and any(c.isspace() for c in n)}
    if not spaced:
        return None
    found = ahocorasick.Automaton()
    for n in spaced:
        found.add_word(n, len(n))
    found.make_automaton()
    return found


def _guarded(text: str, names: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Stretches, from the left and longest first, whose blanks are meant: letters written apart, and names."""
    spans = [m.span() for m in SPACED.finditer(text)]
    if (automaton := _automaton(names)) is not None:
        spans += [(end - n + 1, end + 1) for end, n in automaton.iter(text)]
    last = 0
    for a, z in sorted(spans, key=lambda x: (x[0], -x[1])):
        if a >= last:
            yield a, z
            last = z


def clean(text: str, names: tuple[str, ...] = ()) -> str:
    """A message without its wrappers, control characters and needless blanks; ``names`` and letters written apart as they are."""
    if not text:
        return ""
    held, out, at = [], [], 0
    for a, z in _guarded(text, names):
        out += [text[at:a], f"\ue000{len(held)}\ue001"]
        held.append(text[a:z])
        at = z
    whole = BAD.sub("", "".join(out) + text[at:])
    whole = unwrapped(whole)
    whole = re.sub(r"\n\s*\n+", "\n", re.sub(r"\n[ \t]+", "\n", whole))
    whole = re.sub(r"[ \t]{2,}", " ", BETWEEN.sub("", whole))
    whole = "\n".join(x.strip() for x in whole.split("\n")).strip()
    return re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m[1])] if int(m[1]) < len(held) else m[0], whole) if held else whole


def trimmed(text: str, reply_chars: int = 40, media_chars: int = 30) -> str:
    """Quoted messages and media descriptions cut short; brackets are matched by a stack, so those inside end nothing early.

    A quote loses its number, outer brackets and leading time; a head whose bracket never closes ends the scan.
    """
    if "[" not in text:
        return text
    match, stack = {}, []
    for m in re.finditer(r"[\[\]]", text):
        if m[0] == "[":
            stack.append(m.start())
        elif stack:
            match[stack.pop()] = m.start()
    out, at = [], 0
    while m := HEAD.search(text, at):
        if m["reply"] and not REPLY.match(m[0]):  # case matters here
            out.append(text[at : m.start() + 1])
            at = m.start() + 1
            continue
        end = match.get(m.start())
        if end is None or end < m.end() - 1:
            break
        out.append(text[at : m.start()])
        body = text[m.end() : end]
        if m["reply"]:
            media = re.match(MEDIA_HEAD, body.strip(), re.I)
            inner = re.sub(TIME_HEAD, "", body.strip().strip("[]").strip())
            out.append(f"[Reply: {_cut(inner, media_chars if media else reply_chars)}]")
        else:
            body = body.rstrip()
            tail = re.search(FILE_TAIL, body)
            cut = tail.start() if tail else len(body)
            out.append(f"[{m[4]} {_cut(body[:cut], media_chars)}{body[cut:]}]")
        at = end + 1
    return "".join(out) + text[at:]


def without_mention_ids(text: str) -> str:
    """[At id(nickname: name)] as @name; [At id] goes."""
    named = re.sub(r"\[At\s*-?\d+\s*\(\s*nickname:\s*([^)]*?)\s*\)\s*\]", lambda m: "@" + m[1], text, flags=re.I)
    return re.sub(r"\[At\s*-?\d+\s*\]", "", named, flags=re.I)


def _batched(f: Callable[..., str], *cols: Column) -> Column:
    return F.pandas_udf(lambda *s: pd.Series([f(*x) for x in zip(*s)], dtype=object), "string")(*cols)


def clean_text(c: Column, names: tuple[str, ...] = ()) -> Column:
    """clean() of a column; null as empty."""
    return _batched(lambda t: clean(t, names), F.coalesce(c, F.lit("")))


def model_text(c: Column, names: tuple[str, ...] = (), reply_chars: int = 40, media_chars: int = 30) -> Column:
    """What a model is shown of a message: no reasoning, no wrappers, no ids of mentions, quotes and descriptions cut."""
    return _batched(lambda t: without_mention_ids(trimmed(clean(without_reasoning(t), names), reply_chars, media_chars)), F.coalesce(c, F.lit("")))


def stored_text(level: Column, role: Column, c: Column) -> Column:
    """What is stored of a row: reasoning goes from an assistant's, wrappers from messages (level 0, or none)."""
    f = lambda n, r, t: (lambda x: clean(x) if n == 0 else x)(without_reasoning(t) if r == "assistant" else t).strip()
    return _batched(f, F.coalesce(level.cast("int"), F.lit(0)), F.coalesce(role, F.lit("")), F.coalesce(c, F.lit("")))


def spaced_names(names: DataFrame, most_bytes: int = 16 << 20) -> tuple[str, ...]:
    """The distinct names (name) that hold white space, for clean_text(); they go to every task, so no more than ``most_bytes``."""
    held = names.where(F.col("name").rlike(r"(?U)\S\s+\S")).select("name").distinct()
    size = held.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"names with white space take {size} bytes, over {most_bytes}")
    return tuple(sorted(r["name"] for r in held.collect()))
