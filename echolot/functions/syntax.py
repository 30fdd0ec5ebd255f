"""Units of Python source: what one file's text says, without Spark.

Parsing is the one thing that no column expression does; all that follows from it
is done on DataFrames.  One call per file yields its units, aliases and the calls
of its main block.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import tokenize
from dataclasses import dataclass, field

#: Names that say nothing about likeness: keywords, and the attributes of a dict.
IGNORED_IDENTIFIERS = frozenset(keyword.kwlist) | frozenset(dir(dict))
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_SILENT_TOKENS = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING}


@dataclass
class FileFacts:
    units: list[dict] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    main_calls: list[str] = field(default_factory=list)


def module_name(relative: str) -> str:
    """Dotted name of a file: ``a/b.py`` is ``a.b`` and ``a/__init__.py`` is ``a``."""
    *folders, last = relative.split("/")
    if last != "__init__.py":
        folders.append(last.rsplit(".", 1)[0] if "." in last[1:] else last)
    return ".".join(folders)


def _docstring_of(node) -> str | None:
    head = node.body[0] if node.body else None
    if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
        return head.value.value
    return None


def structure(node: ast.AST) -> str:
    """The tree of ``node`` as text, alike for code that differs in names, docstrings and strings only.

    Names of variables, arguments, functions and classes are numbered in the order
    of the walk, but for those with two underscores on both sides; attributes and
    keywords keep theirs.  Docstrings are left out, other strings are one mark, and
    numbers stay.
    """
    numbers: dict[str, str] = {}

    def named(name: str) -> str:
        if name[:2] == "__" == name[-2:]:
            return name
        return numbers.setdefault(name, f"#{len(numbers)}")

    def text(value) -> str:
        if isinstance(value, ast.AST):
            return walk(value)
        if isinstance(value, list):
            return "[" + ",".join(map(text, value)) + "]"
        return repr(value)

    def walk(n: ast.AST) -> str:
        if isinstance(n, ast.Constant):
            return "S" if isinstance(n.value, str) else f"C{n.value!r}{n.kind or ''}"
        parts = []
        for key, value in ast.iter_fields(n):
            if (key, type(n)) in ((("id"), ast.Name), ("arg", ast.arg)) or key == "name" and isinstance(n, _DEFINITIONS):
                parts.append(named(value))
            elif key == "body" and isinstance(n, _DEFINITIONS) and _docstring_of(n) is not None:
                parts.append(text(value[1:]))
            else:
                parts.append(text(value))
        return f"{type(n).__name__}({';'.join(parts)})"

    return walk(node)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def tree_hash(node: ast.AST) -> str:
    return _digest(structure(node))


def token_hash(source: str) -> str:
    """Hash of the tokens, without comments, line ends and indentation; of the words where they can't be read."""
    try:
        tokens = [(t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in _SILENT_TOKENS]
    except (tokenize.TokenError, SyntaxError, ValueError):
        tokens = [(0, w) for w in source.split()]
    return _digest(repr(tokens))


def calls_in(*nodes: ast.AST) -> set[str]:
    """``f`` for f(...); ``b``, and ``a.b`` where a is a plain name, for a.b(...); nested definitions count."""
    found: set[str] = set()
    for node in nodes:
        for n in ast.walk(node):
            if not isinstance(n, ast.Call):
                continue
            f = n.func
            if isinstance(f, ast.Name):
                found.add(f.id)
            elif isinstance(f, ast.Attribute):
                found.add(f.attr)
                if isinstance(f.value, ast.Name):
                    found.add(f"{f.value.id}.{f.attr}")
    return found


def _parsed(source: str):
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


def identifiers(source: str, dedent: bool = False) -> set[str]:
    """Names in the source, but for ignored and numeric ones; empty if it doesn't parse.

    An indented slice, as of a method, doesn't parse; ``dedent`` strips its margin
    first.
    """
    if dedent:
        from textwrap import dedent as strip

        source = strip(source)
    tree = _parsed(source)
    names: set[str] = set()
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Name):
            names.add(n.id)
        elif isinstance(n, _DEFINITIONS):
            names.add(n.name)
        elif isinstance(n, ast.arg):
            names.add(n.arg)
    return {n for n in names if n and n not in IGNORED_IDENTIFIERS and not n.isdigit()}


def statement_count(source: str) -> int:
    """Statements of the first definition's body, without a leading constant; 0 if the source doesn't parse."""
    tree = _parsed(source.strip())
    if not tree or not tree.body:
        return 0
    body = tree.body[0].body if isinstance(tree.body[0], _DEFINITIONS) else tree.body
    leading = bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant)
    return len(body) - leading


def exported_names(tree: ast.Module) -> set[str]:
    """The strings of the first ``__all__`` that is a list or tuple."""
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, (ast.List, ast.Tuple)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets):
            return {e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return set()


def aliases_of(tree: ast.Module) -> dict[str, str]:
    """Local name to target, from imports and plain assignments of the module's own level; the last one counts."""
    found: dict[str, str] = {}
    for n in tree.body:
        match n:
            case ast.Import(names=names):
                found |= {a.asname or a.name.rpartition(".")[2]: a.name for a in names}
            case ast.ImportFrom(module=module, names=names):
                found |= {a.asname or a.name: f"{module}.{a.name}" if module else a.name for a in names}
            case ast.Assign(targets=[ast.Name(id=target)], value=ast.Name(id=source)):
                found[target] = source
            case ast.Assign(targets=[ast.Name(id=target)], value=ast.Attribute(value=ast.Name(id=owner), attr=attr)):
                found[target] = f"{owner}.{attr}"
    return found


def main_calls_of(tree: ast.Module) -> set[str]:
    """Calls in the bodies of ``if __name__ == "__main__"``, whichever side the name is on."""
    found: set[str] = set()
    for n in tree.body:
        match n:
            case ast.If(test=ast.Compare(left=ast.Name(id="__name__"), ops=[ast.Eq()], comparators=[ast.Constant(value="__main__")])) | ast.If(test=ast.Compare(left=ast.Constant(value="__main__"), ops=[ast.Eq()], comparators=[ast.Name(id="__name__")])):
                found |= calls_in(*n.body)
    return found


def _private(name: str) -> bool:
    return name[:1] == "_" and name[:2] != "__"


def file_facts(text: str, module: str, include_private: bool = True, dedent_identifiers: bool = False) -> FileFacts | None:
    """Units in the order of the walk, aliases and main calls of a file; None if it doesn't parse.

    A private function is left out but what is defined in it isn't; a private class
    is left out with all in it.  A function is a method if it stands in a class and
    in no function.  Qualified names hold the classes around, then the functions.
    """
    tree = _parsed(text)
    if tree is None:
        return None
    lines = text.splitlines(keepends=True)
    exported = exported_names(tree)
    facts = FileFacts(aliases=aliases_of(tree), main_calls=sorted(main_calls_of(tree)))

    def emit(node, kind: str, scope: list[str]) -> None:
        end = node.end_lineno or node.lineno
        source = "".join(lines[node.lineno - 1 : end])
        name, is_class = node.name, kind == "class"
        facts.units.append({
            "name": name, "qualified_name": ".".join(filter(None, [module, *scope, name])), "kind": kind, "lineno": node.lineno, "end_lineno": end,
            "source": source, "docstring": _docstring_of(node), "ast_hash": tree_hash(node), "token_hash": token_hash(source),
            "calls": [] if is_class else sorted(calls_in(node)), "identifiers": sorted(identifiers(source, dedent_identifiers)), "stmt_count": statement_count(source),
            "is_public": name[:1] != "_", "is_dunder": not is_class and name[:2] == "__" and name.endswith("__"), "is_exported": name in exported,
        })

    def walk(node: ast.AST, classes: list[str], functions: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                if include_private or not _private(child.name):
                    emit(child, "class", classes)
                    walk(child, [*classes, child.name], functions)
            elif isinstance(child, _DEFINITIONS):
                if include_private or not _private(child.name):
                    emit(child, "method" if classes and not functions else "function", classes + functions)
                walk(child, classes, [*functions, child.name])
            else:
                walk(child, classes, functions)

    walk(tree, [], [])
    return facts
