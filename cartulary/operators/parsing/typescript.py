"""TypeScript and JavaScript sources: a scanner that knows strings, templates, comments and regular expressions, and a walk over its tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from cartulary.operators.parsing.common import Parsed, Source, function, klass, typed

_TOKEN = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|[{}()\[\];,:?.<>=+\-*/%&|^!~@]|\S")
_SPACE = re.compile(r"\s+")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these a slash starts a regular expression.
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "&&", "||", "??", "return", "typeof", "case", "in", "of", "+", "-", "*", "%", "<", ">", "==", "===", "!=", "!==", "..."}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "accessor"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_STRING = "'\"`"


@dataclass
class Token:
    text: str
    start: int
    end: int
    doc: str | None  # the /** comment right before
    newline: bool  # a line break before

    @property
    def is_name(self) -> bool:
        return self.text[0].isalpha() or self.text[0] in "_$" or ord(self.text[0]) > 127

    @property
    def is_string(self) -> bool:
        return self.text[0] in _STRING and len(self.text) > 1


def _template_end(text: str, at: int) -> int:
    """The end of the template literal that starts at `at`; expressions inside may hold templates."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = _template_end(text, at)
                    continue
                if text[at] in "'\"":
                    at = _string_end(text, at)
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return at


def _string_end(text: str, at: int) -> int:
    quote, at = text[at], at + 1
    while at < len(text) and text[at] not in (quote, "\n"):
        at += 2 if text[at] == "\\" else 1
    return min(at + 1, len(text))


def scan(text: str) -> list[Token]:
    out: list[Token] = []
    at, doc, newline = 0, None, False
    while at < len(text):
        if m := _SPACE.match(text, at):
            newline = newline or "\n" in m[0]
            at = m.end()
            continue
        if text.startswith("//", at) or (at == 0 and text.startswith("#!")):
            at = text.find("\n", at) % (len(text) + 1)
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = len(text) if end < 0 else end + 2
            doc = text[at:end] if text.startswith("/**", at) and end - at > 4 else doc
            newline = newline or "\n" in text[at:end]
            at = end
            continue
        start = at
        if text[at] in "'\"":
            at = _string_end(text, at)
        elif text[at] == "`":
            at = _template_end(text, at)
        elif text[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            at = m.end()
        else:
            at = _TOKEN.match(text, at).end()
        out.append(Token(text[start:at], start, at, doc, newline))
        doc, newline = None, False
    return out


class _Walk:
    def __init__(self, path: str, text: str, export_arrows: bool):
        self.path, self.text, self.export_arrows = path, text, export_arrows
        self.tokens, self.source, self.out = scan(text), Source(text), Parsed()
        self.pairs = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Index of each opening bracket's closing one."""
        stack, pairs = [], {}
        for i, t in enumerate(self.tokens):
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE and stack:
                pairs[stack.pop()] = i
        for i in stack:
            pairs[i] = len(self.tokens) - 1
        return pairs

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def angle_end(self, i: int) -> int:
        """After the type arguments that open at i."""
        depth = 0
        while i < len(self.tokens):
            t = self.at(i)
            if t in _OPEN:
                i = self.pairs[i]
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif t == ";":
                break
            i += 1
        return i

    def type_end(self, i: int, stops: set[str]) -> int:
        """The index after the type that starts at i: at one of stops outside all brackets, or where a line ends the type."""
        first = i
        while i < len(self.tokens):
            t = self.at(i)
            if t in stops and not (t == "{" and (i == first or self.at(i - 1) in ("|", "&", ":", "=>", "is", "extends"))):
                return i
            if t in _CLOSE:
                return i
            if t in _OPEN:
                i = self.pairs[i]
            elif t == "<":
                i = self.angle_end(i) - 1
            elif i > first and self.tokens[i].newline and t not in ("|", "&", "=>", "extends", "?", ":", ".", "[") and self.at(i - 1) not in ("|", "&", "=>", "extends", "?", ":", "keyof", "typeof", "is", "."):
                return i
            i += 1
        return i

    def slice(self, first: int, end: int) -> str:
        return self.text[self.tokens[first].start : self.tokens[end - 1].end] if end > first else ""

    def params(self, i: int) -> str:
        """The parameters between the bracket at i and its closing one, as `name: type`."""
        out, first, end = [], i + 1, self.pairs[i]
        k = first
        while k <= end:
            t = self.at(k)
            if k == end or t == ",":
                if k > first:
                    out.append(self.param(first, k))
                first = k + 1
            elif t in _OPEN:
                k = self.pairs[k]
            elif t == "<":
                k = min(self.angle_end(k), end) - 1
            k += 1
        return ", ".join(out)

    def param(self, first: int, end: int) -> str:
        while self.at(first) == "@":  # decorators
            first += 2
            if self.at(first) == "(":
                first = self.pairs[first] + 1
        while first < end - 1 and (self.at(first) == "..." or self.at(first) in _MODIFIERS and self.tokens[first + 1].is_name):
            first += 1
        name = self.at(first) if self.tokens[first].is_name else "(destructured)"
        k = (self.pairs[first] if self.at(first) in _OPEN else first) + 1
        k += self.at(k) in ("?", "!")
        if k < end and self.at(k) == ":":
            stop = min(self.type_end(k + 1, {"=", ","}), end)
            return f"{name}: {self.slice(k + 1, stop)}"
        return f"{name}: unknown"

    def complexity(self, first: int, end: int) -> int:
        n = 1
        for k in range(first, min(end, len(self.tokens))):
            t, before, after = self.at(k), self.at(k - 1), self.at(k + 1)
            if before in (".", "?.") or after == ":" and t != "?":
                continue
            if t in ("if", "for", "switch", "catch"):
                n += after in ("(", "{", "await")
            elif t == "while":  # of a do statement too, which counts once
                n += after == "("
            elif t == "?":
                n += after not in (":", ",", ")", ";", "=", "]", "}", "") and not self._conditional_type(k)
        return n

    def _conditional_type(self, k: int) -> bool:
        """Whether the question mark at k belongs to `A extends B ? ...`."""
        while k > 0 and self.at(k) not in (";", "{", "}", "=", ",", "("):
            k -= 1
            if self.at(k) == "extends":
                return True
        return False

    def doc(self, first: int) -> str:
        comment = self.tokens[first].doc or ""
        return re.sub(r"^\s*\*", "", comment.replace("/**", "").replace("*/", ""), flags=re.M).strip()

    def start_of(self, i: int) -> int:
        """The first modifier before i."""
        while i > 0 and self.at(i - 1) in _MODIFIERS:
            i -= 1
        return i

    def line(self, offset: int) -> int:
        return self.source.line_of(offset) + 1

    def body_end(self, i: int) -> int:
        """The index after the body that starts at i: a block, or nothing."""
        return self.pairs[i] + 1 if self.at(i) == "{" else i

    def expression_end(self, i: int) -> int:
        """The index after the expression that starts at i."""
        first = i
        while i < len(self.tokens):
            t = self.at(i)
            if t in (";", ",") or t in _CLOSE:
                return i
            if i > first and self.tokens[i].newline and (self.tokens[i].is_name or self.tokens[i].is_string) and self.at(i - 1) not in _BEFORE_REGEX:
                return i
            i = self.pairs[i] + 1 if t in _OPEN else i + 1
        return i

    def signature(self, i: int, stops: set[str]) -> tuple[str, int] | None:
        """(signature, index after it) of parameters and return type from i on."""
        if self.at(i) == "<":
            i = self.angle_end(i)
        if self.at(i) != "(":
            return None
        params, k, returns = self.params(i), self.pairs[i] + 1, "void"
        if self.at(k) == ":":
            end = self.type_end(k + 1, stops)
            returns, k = self.slice(k + 1, end), end
        return f"({params}) => {returns}", k

    def add(self, name: str, full_name: str, signature: str, first: int, start: int, end: int, exported: bool, is_async: bool) -> None:
        """first: the token that has the comment; start and end: the node's tokens."""
        stop = self.tokens[min(end, len(self.tokens)) - 1].end
        self.out.functions.append(function(self.path, name, full_name, signature, self.doc(first), self.complexity(start, end), self.line(self.tokens[start].start), self.line(stop), exported, is_async))

    def function(self, i: int) -> None:
        """`function` at i: a declaration or an expression."""
        k = i + 1 + (self.at(i + 1) == "*")
        name = "(anonymous)"
        if k < len(self.tokens) and self.tokens[k].is_name:
            name, k = self.at(k), k + 1
        if (s := self.signature(k, {"{", ";"})) is not None:
            first = self.start_of(i)
            mods = [self.at(j) for j in range(first, i)]
            self.add(name, name, s[0], first, first, self.body_end(s[1]), "export" in mods, "async" in mods)

    def arrow(self, i: int) -> tuple[str, int, int, bool] | None:
        """(signature, start, end, async) if an arrow function starts at i."""
        k, is_async = i, False
        if self.at(k) == "async" and not (self.at(k + 1) == "=>"):
            k, is_async = k + 1, True
        if k + 1 < len(self.tokens) and self.tokens[k].is_name and self.at(k + 1) == "=>":
            signature, body = f"({self.at(k)}: unknown) => void", k + 2
        else:
            s = self.signature(k, {"=>"})
            if s is None or self.at(s[1]) != "=>":
                return None
            signature, body = s[0], s[1] + 1
        end = self.body_end(body) if self.at(body) == "{" else self.expression_end(body)
        return signature, i, end, is_async

    def variables(self, i: int) -> None:
        """const, let or var at i: the declarators that are arrow functions."""
        statement, k = self.start_of(i), i + 1
        while k < len(self.tokens):
            name = self.at(k) if self.tokens[k].is_name else "(anonymous)"
            k = self.pairs[k] + 1 if self.at(k) in ("{", "[") else k + 1
            k += self.at(k) == "!"
            if self.at(k) == ":":
                k = self.type_end(k + 1, {"=", ",", ";", "of", "in"})
            if self.at(k) != "=":
                return
            if (a := self.arrow(k + 1)) is not None:
                exported = self.export_arrows and "export" in [self.at(j) for j in range(statement, i)]
                self.add(name, name, a[0], statement, a[1], a[2], exported, a[3])
            k = self.expression_end(k + 1)
            if self.at(k) != ",":
                return
            k += 1

    def heritage(self, i: int, end: int) -> list[str]:
        """The types listed from i on."""
        out, first = [], i
        while i <= end:
            t = self.at(i)
            if i == end or t == ",":
                out.append(self.slice(first, i))
                first = i + 1
            elif t == "<":
                i = self.angle_end(i) - 1
            elif t in _OPEN:
                i = self.pairs[i]
            i += 1
        return [x for x in out if x]

    def klass(self, i: int) -> None:
        """`class` at i, if it is a declaration with a name."""
        if not (i + 1 < len(self.tokens) and self.tokens[i + 1].is_name and self.at(i + 1) not in ("extends", "implements")):
            return
        first = self.start_of(i)
        if self.at(first - 1) in ("=", "(", ",", "return", ":", "=>"):
            return
        name, k = self.at(i + 1), i + 2
        k = self.angle_end(k) if self.at(k) == "<" else k
        extends, implements = None, []
        for word in ("extends", "implements"):
            if self.at(k) == word:
                end = k + 1
                while end < len(self.tokens) and self.at(end) not in ("{", "implements"):
                    end = self.angle_end(end) if self.at(end) == "<" else self.pairs[end] + 1 if self.at(end) == "(" else end + 1
                types = self.heritage(k + 1, end)
                extends, implements = (types[0] if types else None, implements) if word == "extends" else (extends, types)
                k = end
        if self.at(k) != "{":
            return
        methods, properties = self.members(name, k)
        p = self.path
        self.out.classes.append(klass(p, name, [f"{p}:{name}.{m}" for m in methods], properties, extends and f"{p}:{extends}", [f"{p}:{x}" for x in implements], "export" in [self.at(j) for j in range(first, i)]))

    def members(self, owner: str, i: int) -> tuple[list[str], list[str]]:
        methods, properties, k, end = [], [], i + 1, self.pairs[i]
        while k < end:
            if self.at(k) in (";", ","):
                k += 1
                continue
            first = k
            while self.at(k) == "@":
                k += 2
                while self.at(k) == ".":
                    k += 2
                k = self.pairs[k] + 1 if self.at(k) == "(" else k
            mods = []
            while self.at(k) in _MODIFIERS and self.at(k + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
                mods.append(self.at(k))
                k += 1
            accessor = self.at(k) in ("get", "set") and self.at(k + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}")
            k += accessor
            k += self.at(k) == "*"
            if self.at(k) == "{":  # static block
                k = self.pairs[k] + 1
                continue
            named = self.tokens[k].is_name
            name = self.at(k)
            k = self.pairs[k] + 1 if self.at(k) == "[" else k + 1
            optional = self.at(k) in ("?", "!")
            k += optional
            if self.at(k) in ("(", "<"):
                s = self.signature(k, {"{", ";"})
                if s is None:
                    k += 1
                    continue
                after = self.body_end(s[1])
                if not accessor and name != "constructor":
                    shown = name if named else "(anonymous)"
                    methods.append(name if named else "(anon)")
                    self.add(shown, f"{owner}.{shown}", s[0], first, first, after, False, "async" in mods)
                k = after
                continue
            if named and not accessor:
                properties.append(name)
            if self.at(k) == ":":
                k = self.type_end(k + 1, {"=", ";"})
            if self.at(k) == "=":
                k = self.expression_end(k + 1)
            k = max(k, first + 1)
        return methods, properties

    def signatures(self, i: int) -> list[str]:
        """Property signatures of the interface body at i."""
        out, k, end = [], i + 1, self.pairs[i]
        while k < end:
            if self.at(k) in (";", ","):
                k += 1
                continue
            first = k
            while self.at(k) in ("readonly", "get", "set") and self.at(k + 1) not in (":", "?", "(", ";", ",", "<"):
                k += 1
            name, index = (self.at(k) if self.tokens[k].is_name else "(computed)"), self.at(k) == "["
            k = self.pairs[k] + 1 if self.at(k) in _OPEN else k + 1
            k += self.at(k) == "?"
            if self.at(k) in ("(", "<"):
                k = (self.signature(k, {";", ","}) or ("", k + 1))[1]
                continue
            if not index:
                out.append(name)
            if self.at(k) == ":":
                k = self.type_end(k + 1, {";", ","})
            k = max(k, first + 1)
        return out

    def enum(self, i: int) -> list[str]:
        out, k, end = [], i + 1, self.pairs[i]
        while k < end:
            out.append(self.at(k) if self.tokens[k].is_name else "(computed)")
            k = self.expression_end(k) + 1
        return out

    def modules(self, i: int) -> None:
        """import or export at i: the module that it names."""
        k = i + 1
        if self.at(i) == "import":
            if self.at(k) in ("(", "."):
                return
            if k < len(self.tokens) and self.tokens[k].is_string:
                self.out.imports.append(self.at(k)[1:-1])
                return
        elif self.at(k) not in ("*", "{", "type"):
            return
        while k < len(self.tokens) and self.at(k) not in (";", "="):
            if self.at(k) == "from" and k + 1 < len(self.tokens) and self.tokens[k + 1].is_string:
                self.out.imports.append(self.at(k + 1)[1:-1])
                return
            if k > i + 1 and self.tokens[k].newline and self.at(k) in ("import", "export", "const", "let", "function", "class"):
                return
            k = self.pairs[k] + 1 if self.at(k) == "{" else k + 1

    def run(self) -> Parsed:
        for i, t in enumerate(self.tokens):
            before, after = self.at(i - 1), self.at(i + 1)
            if before in (".", "?.") or after == ":" and t.text != "default":
                continue
            named = i + 1 < len(self.tokens) and self.tokens[i + 1].is_name
            if t.text in ("import", "export"):
                self.modules(i)
            elif t.text == "function":
                self.function(i)
            elif t.text in ("const", "let", "var") and after != "enum":
                self.variables(i)
            elif t.text == "class":
                self.klass(i)
            elif t.text == "interface" and named:
                k = i + 2
                while k < len(self.tokens) and self.at(k) != "{":
                    k = self.angle_end(k) if self.at(k) == "<" else k + 1
                if k < len(self.tokens):
                    self.out.types.append(typed(self.path, after, "interface", self.signatures(k)))
            elif t.text == "type" and named and before not in ("import", ",", "{", "("):
                k = self.angle_end(i + 2) if self.at(i + 2) == "<" else i + 2
                if self.at(k) == "=":
                    self.out.types.append(typed(self.path, after, "type", []))
            elif t.text == "enum" and named and self.at(i + 2) == "{":
                self.out.types.append(typed(self.path, after, "enum", self.enum(i + 2)))
        return self.out


def parse(path: str, text: str, export_arrows: bool = False) -> Parsed:
    """Entities of a source. Methods are never exported, and arrow functions only with export_arrows (their declaration is exported, not they)."""
    return _Walk(path, text, export_arrows).run()
