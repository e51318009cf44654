"""Definitions of TypeScript and C# sources, in one pass over their tokens with a stack of brackets.

The lexer skips comments and strings, the code in template holes (``${}``) excepted; verbatim, interpolated and raw strings of C#
and regular expressions of TypeScript are strings. At each opening brace the tokens since the last boundary on its level (the head) say
what it opens: a class or interface, a function, method or arrow, or something else. Every token is looked at a bounded number of times,
so the time is linear in the source, whatever the nesting.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

_TS = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*(?:.*?\*/|.*)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)|(?P<word>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<num>\d[\w.]*)|(?P<arrow>=>)|(?P<tick>`)|(?P<punct>.)", re.S)
_CS = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*(?:.*?\*/|.*)|\$*(?P<raw>\"{3,}).*?(?P=raw)|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"?|\$\"(?:\\.|\{\{|\{[^{}\"\n]*(?:\"[^\"\n]*\"[^{}\"\n]*)*\}|[^\"\\\n{])*\"?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'|\#[a-z]+[^\n]*)|(?P<word>@?[A-Za-z_\u0080-\U0010ffff]\w*)|(?P<num>\d[\w.]*)|(?P<arrow>=>)|(?P<punct>.)", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_HOLE = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)
_NO_CALL = frozenset("if for foreach while switch catch return function lock using fixed when typeof sizeof default checked unchecked await yield throw new delete void in of super base this async".split())
_VALUE_AFTER = frozenset("return typeof case in of delete void throw new await yield else do".split())
_GOES_ON = frozenset("extends implements where instanceof in of as satisfies is".split())
_MODIFIERS = frozenset("export default public private protected internal static async abstract readonly override declare get set virtual sealed partial const let var new extern unsafe".split())
_TYPES = {"class": "class", "interface": "interface", "struct": None, "enum": None, "record": None}


class Token:
    __slots__ = ("text", "start", "end", "word", "call")

    def __init__(self, text: str, start: int, end: int, word: bool, call: int = -1):
        self.text, self.start, self.end, self.word, self.call = text, start, end, word, call


def lex(source: str, language: str) -> Iterator[Token]:
    """Words, numbers and punctuation; a whole string counts as the word ``""``."""
    ts = language != "csharp"
    match, at, n, last = (_TS if ts else _CS).match, 0, len(source), None
    holes: list[int] = []  # open braces in each template hole

    def template(at: int) -> int:
        """From within a template: behind its end, or into its next hole."""
        at = _HOLE.match(source, at).end()
        if source.startswith("${", at):
            holes.append(0)
            return at + 2
        return at + 1

    while at < n:
        m = match(source, at)
        kind, text, start, at = m.lastgroup if m.lastgroup != "raw" else "skip", m[0], m.start(), m.end()
        if kind == "skip":
            if text[0] in "'\"@$":
                yield (last := Token('""', start, at, False))
            continue
        if kind == "tick":
            at = template(at)
            yield (last := Token('""', start, at, False))
            continue
        if holes and text == "{":
            holes[-1] += 1
        elif holes and text == "}":
            if not holes[-1]:
                holes.pop()
                at = template(at)
                continue
            holes[-1] -= 1
        elif ts and text == "/" and (last is None or (last.word and last.text in _VALUE_AFTER) or (not last.word and last.text not in (")", "]", "}", '""') and not last.text[0].isdigit())):
            if r := _REGEX.match(source, start):
                at = r.end()
                yield (last := Token('""', start, at, False))
                continue
        yield (last := Token(text, start, at, kind == "word"))


class Frame:
    """An open bracket: what it is in, the head before it, and the arrows without braces that are open in it."""

    __slots__ = ("open", "kind", "chunk", "owner", "head", "arrows")

    def __init__(self, open_: str, kind: str, chunk: int | None, owner: str | None):
        self.open, self.kind, self.chunk, self.owner, self.head, self.arrows = open_, kind, chunk, owner, [], []


def _named(head: list[Token], at: int) -> Token | None:
    """The word before place ``at`` of a head, type parameters skipped."""
    k, depth = at - 1, 0
    while k >= 0 and (depth or head[k].text == ">"):
        depth += (head[k].text == ">") - (head[k].text == "<")
        k -= 1
    return head[k] if k >= 0 and head[k].word and head[k].text not in _NO_CALL else None


def _bases(head: list[Token], at: int) -> list[str]:
    """What a class names behind ``extends``, ``implements`` or a colon, up to ``where``."""
    out, text, depth, on = [], "", 0, False
    for t in head[at:]:
        if not depth and (t.text in ("extends", "implements") or (t.text == ":" and not on)):
            on, out, text = True, out + [text], ""
        elif on and not depth and t.text == ",":
            out, text = out + [text], ""
        elif on and t.text == "where" and not depth:
            break
        elif not on:
            depth += (t.text == "<") - (t.text == ">")
        elif t.text != "()":
            depth += (t.text == "<") - (t.text == ">")
            text += t.text + (" " if t.text == "," else "")
    return [b for b in [*out, text] if b]


def _method(head: list[Token], frame: Frame, ts: bool) -> tuple[str, int] | None:
    """Name of the function that a head declares, and the place of its parameters."""
    words = {t.text for t in head if t.word}
    for k, t in enumerate(head):
        if t.text == "=":
            name = head[k - 1].text if k and head[k - 1].word else "anonymous"
            if ts and "function" in words:
                p = next((i for i in range(k, len(head)) if head[i].text == "()"), -1)
                return (name, p) if p > k and any(x.text == "function" for x in head[k:p]) else None
            return None
        if t.text == "()":
            if ts and "function" in words:
                own = _named(head, k)
                return (own.text if own else "anonymous"), k
            own = _named(head, k) if frame.kind in ("type", "object") else None
            # a C# attribute or base call has no place here: the first parameters are the method's
            return (own.text, k) if own else None
    return None


def definitions(source: str, language: str) -> list[dict]:
    """kind, name, start, end, owner, bases, calls, methods of each definition, in the order of their starts."""
    ts = language != "csharp"
    frames, chunks, calls = [Frame("", "block", None, None)], [], []
    prev, before, chain, fresh = None, None, "", source.find

    def add(kind: str, name: str, start: int, bases: list[str] = ()) -> int:
        frame = frames[-1]
        if kind == "function" and frame.kind == "type" and frame.chunk is not None:
            chunks[frame.chunk]["methods"] += 1
        chunks.append({"kind": kind, "name": name, "start": start, "end": len(source), "owner": frame.owner, "bases": list(bases), "methods": 0})
        return len(chunks) - 1

    def boundary(end: int) -> None:
        frame = frames[-1]
        for c in frame.arrows:
            chunks[c]["end"] = end
        frame.arrows, frame.head = [], []

    def start_of(head: list[Token]) -> int:
        return next((t.start for t in head if t.text not in ("export", "default")), head[0].start)

    def arrow(head: list[Token]) -> tuple[str, int]:
        """Name and start of the arrow function whose head ends in its parameters."""
        at = next((k for k in range(len(head) - 1, -1, -1) if head[k].text == "()"), len(head) - 1)
        if head and head[-1].word and (len(head) < 2 or head[-2].text not in (":", "|", ".", "<", ",")):
            at = len(head) - 1
        first = at - 1 if at > 0 and head[at - 1].text == "async" else at
        k = first - 1
        if k > 0 and head[k].text in ("=", ":"):
            # a type may stand between the name and the sign
            k = next((i for i in range(k) if head[i].text == ":"), k)
            return (head[k - 1].text if k and head[k - 1].word else "anonymous"), head[first].start
        return "anonymous", head[first].start if head else 0

    for t in lex(source, language):
        frame, text = frames[-1], t.text
        if ts and prev is not None and (t.word or text in ("@", "#", "[")) and text not in _GOES_ON and frame.head and frame.open in ("", "{") and (prev.word and prev.text not in _MODIFIERS or prev.text in (")", "]", "}", '""', ";") or prev.text[0].isdigit()) and fresh("\n", prev.end, t.start) >= 0:
            boundary(prev.end)
        if prev is not None and prev.text == "=>" and text != "{" and ts:
            name, start = arrow(frame.head[:-1])
            frame.arrows.append(add("function", name, start))
        head = frame.head
        if t.word:
            chain = f"{chain}.{text}" if prev is not None and prev.text == "." and chain else text
            head.append(t)
        elif text in "([":
            # directly in a type stand declarations, and attributes in brackets of their own
            declares = frame.kind == "type" and not any(x.text in ("=", "=>") for x in head)
            attribute = frame.open == "[" and len(frames) > 1 and frames[-2].kind in ("type", "block") and not frames[-2].head[:-1] and not ts
            called = text == "(" and not declares and not attribute and prev is not None and prev.word and prev.text not in _NO_CALL and not (before is not None and before.text in ("new", "function"))
            inner = Frame(text, "list", None, frame.owner)
            if called:
                calls.append((t.start, chain))
            frames.append(inner)
            head.append(Token("()" if text == "(" else "[]", t.start, t.end, False, len(calls) - 1 if called else -1))
        elif text == "{":
            at = next((k for k, x in enumerate(head) if x.word and x.text in _TYPES and (not k or head[k - 1].text not in (".", ":", ",")) and k + 1 < len(head) + (x.text == "class")), None)
            made, kind, owner = None, "block", frame.owner
            if at is not None and not any(x.text in ("()", "=>") for x in head[:at]):
                named = at + 1 < len(head) and head[at + 1].word and head[at + 1].text not in ("extends", "implements")
                # "record struct", "record class": the name comes last
                if named and head[at + 1].text in _TYPES and at + 2 < len(head):
                    at += 1
                name = head[at + 1].text if named else "anonymous"
                kind = "type"
                if what := _TYPES[head[at].text]:
                    made = add(what, name, start_of(head), _bases(head, at + 1))
                    owner = name if what == "class" else owner
            elif head and head[-1].text == "=>":
                if ts:
                    name, start = arrow(head[:-1])
                    made = add("function", name, start)
            elif found := _method(head, frame, ts):
                name, k = found
                if 0 <= head[k].call < len(calls):
                    calls[head[k].call] = (calls[head[k].call][0], "")
                first = next((x.start for x in head if x.text == "function"), None) if any(x.text == "=" for x in head[:k]) else None
                made = add("function", name, start_of(head) if first is None else first)
            elif ts and prev is not None and prev.text in ("=", "(", ",", ":", "return", "[", "?"):
                kind = "object"
            frames.append(Frame("{", kind, made, owner))
        elif text in ")]}":
            boundary(prev.end if prev is not None else t.start)
            if len(frames) > 1:
                closed = frames.pop()
                if closed.chunk is not None:
                    chunks[closed.chunk]["end"] = t.end
                if text == "}":
                    if closed.kind == "object":
                        frames[-1].head.append(Token('""', t.start, t.end, False))
                    else:
                        boundary(t.end)
        elif text == ";" or (text == "," and frame.kind in ("list", "object")):
            boundary(prev.end if prev is not None and text == "," else t.end)
        else:
            if text == "=>" and not ts and frame.kind == "type" and (found := _method(head, frame, ts)):
                name, k = found
                if 0 <= head[k].call < len(calls):
                    calls[head[k].call] = (calls[head[k].call][0], "")
                frame.arrows.append(add("function", name, start_of(head)))
            head.append(t)
        if not t.word and text not in (".", "?"):
            chain = ""
        prev, before = t, prev
    if prev is not None:
        while frames:
            boundary(prev.end)
            frames.pop()
    calls = [c for c in calls if c[1]]
    places = [c[0] for c in calls]
    for c in chunks:
        c["calls"] = sorted({x[1] for x in calls[bisect_left(places, c["start"]) : bisect_left(places, c["end"])]})
    return sorted(chunks, key=lambda c: (c["start"], -c["end"]))


def line_of(starts: list[int], at: int) -> int:
    """Line (from 1) of a place; ``starts``: where each line begins."""
    return bisect_right(starts, at)
