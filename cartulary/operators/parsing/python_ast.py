"""Python sources by their syntax tree: top-level functions and classes."""

from __future__ import annotations

import ast

from cartulary.operators.parsing.common import Parsed, function, klass, typed

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)


def parse(path: str, text: str) -> Parsed:
    """Raises SyntaxError for what isn't Python."""
    out = Parsed()
    for node in ast.parse(text).body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            returns = ast.unparse(node.returns) if node.returns else "None"
            out.functions.append(function(path, node.name, node.name, f"({ast.unparse(node.args)}) -> {returns}", ast.get_docstring(node) or "", 1 + sum(isinstance(x, _BRANCHES) for x in ast.walk(node)), node.lineno, node.end_lineno or node.lineno, not node.name.startswith("_"), isinstance(node, ast.AsyncFunctionDef)))
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            methods = [f"{path}:{node.name}.{x.name}" for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
            out.classes.append(klass(path, node.name, methods, [], f"{path}:{bases[0]}" if bases else None, [f"{path}:{b}" for b in bases[1:]], not node.name.startswith("_")))
            marks = {ast.unparse(d).split("(")[0].rpartition(".")[2] for d in node.decorator_list}
            if "dataclass" in marks or any(b.rpartition(".")[2] == "TypedDict" for b in bases):
                out.types.append(typed(path, node.name, "type", []))
    return out
