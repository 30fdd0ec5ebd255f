import ast
from textwrap import dedent

from echolot.functions import syntax


def facts(text, module="m", **options):
    return syntax.file_facts(dedent(text), module, **options)


def tree(text):
    return syntax.tree_hash(ast.parse(dedent(text)).body[0])


NESTED = """
    __all__ = ["Box", "make"]
    import os.path as p, a.b
    from c import d as e, f
    from . import g
    alias = make
    other = p.join

    def make(x):
        'Says so.'
        def inner(y):
            return y.go() + make(y)
        return inner(x)

    class Box:
        def put(self):
            def deep(): pass
            class Local:
                def m(self): pass
        def _hidden(self):
            def seen(): pass
    class _Secret:
        def gone(self): pass

    def outer():
        class C:
            def f(self): pass

    if "__main__" == __name__:
        make(1); p.join("a")
    else:
        outer()
    """


def test_units_kinds_and_names():
    got = {u["qualified_name"]: u["kind"] for u in facts(NESTED).units}
    assert got["m.make"] == "function" and got["m.make.inner"] == "function"
    assert got["m.Box"] == "class" and got["m.Box.put"] == "method"
    assert got["m.Box.put.deep"] == "function" and got["m.Box.Local"] == "class" and got["m.Box.Local.put.m"] == "function"
    # Classes come before functions in a name, and the class in a function loses the function.
    assert got["m.C"] == "class" and got["m.C.outer.f"] == "function"
    assert "m._Secret.gone" in got


def test_private_filter():
    got = {u["qualified_name"] for u in facts(NESTED, include_private=False).units}
    assert "m.Box._hidden" not in got and "m.Box._hidden.seen" in got
    assert not any("_Secret" in q for q in got)


def test_flags_docstring_calls():
    by = {u["name"]: u for u in facts(NESTED).units}
    assert by["make"]["is_exported"] and by["make"]["docstring"] == "Says so." and by["make"]["calls"] == ["go", "inner", "make", "y.go"]
    assert by["Box"]["calls"] == [] and not by["_Secret"]["is_public"]


def test_aliases_and_main():
    f = facts(NESTED)
    assert f.aliases == {"p": "os.path", "b": "a.b", "e": "c.d", "f": "c.f", "g": "g", "alias": "make", "other": "p.join"}
    assert f.main_calls == ["join", "make", "p.join"]


def test_tree_hash_ignores_names_docstrings_and_strings():
    a = tree("def f(a, b):\n 'doc'\n x = a + b\n return g(x, 'one')")
    assert a == tree("def h(p, q):\n y = p + q\n return k(y, 'two')")
    assert a != tree("def h(p, q):\n y = p + p\n return k(y, 'two')")
    assert tree("def f(): return 1") != tree("def f(): return 2")
    assert tree("def f(a): return a.x") != tree("def f(a): return a.y")
    assert tree("def f(): return __name__") != tree("def f(): return __file__")


def test_token_hash_ignores_layout_and_indentation():
    assert syntax.token_hash("def f(a):\n    return a # x\n") == syntax.token_hash("def f( a ):\n\n  return a\n")
    # Equal tokens, other trees.
    one, two = "def f(a):\n  if a:\n    x\n    y", "def f(a):\n  if a:\n    x\n  y"
    assert syntax.token_hash(one) == syntax.token_hash(two) and tree(one) != tree(two)
    assert syntax.token_hash("((( ' x") == syntax.token_hash("(((  '  x")


def test_identifiers():
    assert syntax.identifiers("def f(a):\n return print(items, get, len(a.b))") == {"f", "a", "print", "len"}
    method = "    def m(self):\n        return self.x"
    assert syntax.identifiers(method) == set()
    assert syntax.identifiers(method, dedent=True) == {"m", "self"}


def test_statement_count():
    assert syntax.statement_count("  def f():\n    'd'\n    x = 1\n    return x") == 2
    assert syntax.statement_count("def f():\n 'd'\n x = 1\n return x") == 2
    assert syntax.statement_count("def f(): ...") == 0
    assert syntax.statement_count("") == syntax.statement_count("def (") == 0


def test_bad_files_and_module_names():
    assert facts("def (") is None
    assert [syntax.module_name(p) for p in ("a/b.py", "a/__init__.py", "x.pyi", "__init__.py")] == ["a.b", "a", "x", ""]
