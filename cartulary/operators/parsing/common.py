"""What all parsers give, and an outline of a source: one forward pass that knows strings and comments."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field


@dataclass
class Parsed:
    functions: list[dict] = field(default_factory=list)
    classes: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)


def function(path: str, name: str, full_name: str, signature: str, doc: str, complexity: int, start: int, end: int, exported: bool, is_async: bool) -> dict:
    return {"file_id": path, "name": name, "full_name": full_name, "signature": signature, "doc_comment": doc, "complexity": complexity, "start_line": start, "end_line": end, "is_exported": exported, "is_async": is_async}


def klass(path: str, name: str, methods: list[str], properties: list[str], extends: str | None, implements: list[str], exported: bool) -> dict:
    return {"file_id": path, "name": name, "methods": methods, "properties": properties, "extends_id": extends, "implements_ids": implements, "is_exported": exported}


def typed(path: str, name: str, kind: str, properties: list[str]) -> dict:
    return {"file_id": path, "name": name, "kind": kind, "properties": properties}


class Source:
    """A text by lines; line numbers start at 0."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self._starts = [0]
        for x in self.lines:
            self._starts.append(self._starts[-1] + len(x) + 1)

    def line_of(self, offset: int) -> int:
        return bisect.bisect_right(self._starts, offset) - 1

    def count(self, pattern: re.Pattern, first: int, last: int) -> int:
        """Matches in the lines first to last."""
        return sum(len(pattern.findall(x)) for x in self.lines[first : last + 1])


class Outline(Source):
    """A text with what one pass over its lexemes finds: code (the text with blanks for comments and strings), the brace blocks as
    pairs of offsets with their parent, and the comments by the line they start in.

    lexemes: a pattern with groups `comment` and `string` and single braces; marks: what starts a comment that documents.
    """

    def __init__(self, text: str, lexemes: re.Pattern, marks: tuple[str, ...] = ()):
        super().__init__(text)
        self.close: dict[int, int] = {}  # offset of `{` -> offset of its `}`, or the end of the text
        self.parent: dict[int, int | None] = {}
        self.notes: dict[int, str] = {}  # line -> text of a documenting comment
        self._marks, self._strings = marks, set()
        self.code = self._blanked(lexemes)
        self.opens = sorted(self.close)
        #: Lines with anything else than comments.
        self.code_lines = sorted(self._strings | {i for i, x in enumerate(self.code.split("\n")) if x.strip()})

    def _blanked(self, lexemes: re.Pattern) -> str:
        blank = lambda x: re.sub(r"[^\n]", " ", x)
        out, done, stack = [], 0, []
        for m in lexemes.finditer(self.text):
            if m.lastgroup in ("comment", "string"):
                out += [self.text[done : m.start()], blank(m[0])]
                done = m.end()
                line = self.line_of(m.start())
                if m.lastgroup == "string":
                    self._strings.add(line)
                elif (mark := next((x for x in self._marks if m[0].startswith(x)), None)) is not None:
                    self.notes[line] = m[0][len(mark) :].strip()
            elif m[0] == "{":
                self.parent[m.start()] = stack[-1] if stack else None
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        self.close |= dict.fromkeys(stack, len(self.text))
        return "".join([*out, self.text[done:]])

    def block(self, offset: int) -> tuple[int, int] | None:
        """First and last line of the first block that opens at or after offset."""
        at = bisect.bisect_left(self.opens, offset)
        if at == len(self.opens):
            return None
        return self.line_of(self.opens[at]), self.line_of(min(self.close[self.opens[at]], len(self.text)))

    def around(self, offset: int) -> int | None:
        """The innermost block that offset lies in."""
        at = bisect.bisect_left(self.opens, offset) - 1
        inner = self.opens[at] if at >= 0 else None
        while inner is not None and self.close[inner] < offset:
            inner = self.parent[inner]
        return inner

    def note_before(self, line: int, reach: int | None = None) -> str:
        """The documenting comments that come before a line with no code between, at most `reach` lines away."""
        at = bisect.bisect_left(self.code_lines, line)
        first = self.code_lines[at - 1] + 1 if at else 0
        first = first if reach is None else max(first, line - reach)
        return "\n".join(self.notes[x] for x in range(first, line) if x in self.notes)


def heading(match: re.Match, parity: bool) -> int:
    """Where a declaration's match begins; with parity the blank lines that the pattern took before it belong to it."""
    return match.start() if parity else match.start() + len(match[0]) - len(match[0].lstrip())
