"""Static diagnostics of Python code as rows.  Code is parsed, never run."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the fields of a diagnostic, as linters report them.
SCHEMA = "type string, module string, obj string, line int, column int, path string, symbol string, message string, message_id string"


def _bound(tree: ast.AST) -> set[str]:
    """Every name that the module binds anywhere."""
    out: set[str] = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            out.add(n.id)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(n.name)
        elif isinstance(n, ast.arg):
            out.add(n.arg)
        elif isinstance(n, ast.alias):
            out.add((n.asname or n.name).split(".")[0])
        elif isinstance(n, ast.ExceptHandler) and n.name:
            out.add(n.name)
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            out.update(n.names)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            out.add(n.name)
    return out


_GIVEN = {*dir(builtins), "__file__", "__name__", "__doc__", "__package__", "__spec__", "__loader__"}


def _arity(f: ast.FunctionDef) -> tuple[list[str], list[str], bool, bool]:
    """Names of positional parameters, of those without a default, and whether any number of either kind may be given."""
    a = f.args
    names = [x.arg for x in (*a.posonlyargs, *a.args)]
    return names, names[: len(names) - len(a.defaults)], a.vararg is not None, a.kwarg is not None


def diagnose(code: str, module: str = "main") -> list[tuple]:
    """Errors of a text: what does not parse, else what the syntax tree tells.

    Names that nothing binds; functions and classes defined anew in one scope; methods without parameters or whose
    first is not self; return outside a function, break and continue outside a loop; calls of functions of the
    module, bound once, with too many or missing arguments.
    """
    path = f"{module}.py"
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line, column = getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 0
        return [("error", module, "", line, column, path, "syntax-error", getattr(e, "msg", None) or str(e), "E0001")]
    starred = any(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in ast.walk(tree))
    known = _bound(tree) | _GIVEN
    functions = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef) and not n.decorator_list}
    rebound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    out = []

    def tell(node: ast.AST, obj: str, symbol: str, message: str, number: str) -> None:
        out.append(("error", module, obj, node.lineno, node.col_offset, path, symbol, message, number))

    def called(node: ast.Call, obj: str) -> None:
        f = functions.get(node.func.id) if isinstance(node.func, ast.Name) and node.func.id not in rebound else None
        if f is None or any(isinstance(x, ast.Starred) for x in node.args) or any(k.arg is None for k in node.keywords):
            return
        names, needed, many, _ = _arity(f)
        if len(node.args) > len(names) and not many:
            tell(node, obj, "too-many-function-args", "Too many positional arguments for function call", "E1121")
        given = {*names[: len(node.args)], *(k.arg for k in node.keywords)}
        for x in needed:
            if x not in given:
                tell(node, obj, "no-value-for-parameter", f"No value for argument {x!r} in function call", "E1120")

    stack: list[tuple[ast.AST, str, str, bool]] = [(tree, "", "module", False)]  # node, its object, what holds it, in a loop
    while stack:
        node, obj, holder, looped = stack.pop()
        seen: dict[str, int] = {}
        for child in ast.iter_child_nodes(node):
            inner, held, loop = obj, holder, looped
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner, held, loop = f"{obj}.{child.name}".lstrip("."), "class" if isinstance(child, ast.ClassDef) else "function", False
                if child.name in seen and not child.decorator_list and isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef)):
                    what = "class" if held == "class" else "method" if holder == "class" else "function"
                    tell(child, inner, "function-redefined", f"{what} already defined line {seen[child.name]}", "E0102")
                seen.setdefault(child.name, child.lineno)
                if held == "function" and holder == "class" and not child.decorator_list:
                    names, _, many, _ = _arity(child)
                    if not names and not many:
                        tell(child, inner, "no-method-argument", "Method has no argument", "E0211")
                    elif names and names[0] != "self" and child.name not in ("__new__", "__init_subclass__", "__class_getitem__"):
                        tell(child, inner, "no-self-argument", 'Method should have "self" as first argument', "E0213")
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load) and child.id not in known and not starred:
                tell(child, obj, "undefined-variable", f"Undefined variable {child.id!r}", "E0602")
            elif isinstance(child, ast.Return) and holder != "function":
                tell(child, obj, "return-outside-function", "Return outside function", "E0104")
            elif isinstance(child, (ast.Break, ast.Continue)) and not looped:
                tell(child, obj, "not-in-loop", f"{type(child).__name__.lower()!r} not properly in loop", "E0103")
            elif isinstance(child, ast.Call):
                called(child, obj)
            elif isinstance(child, (ast.For, ast.AsyncFor, ast.While)):
                loop = True
            elif isinstance(child, ast.Lambda):
                held = "function"
            stack.append((child, inner, held, loop))
    return sorted(out, key=lambda d: (d[3], d[4], d[8]))


def diagnostics(code: DataFrame, key: str = "doc_id", text: str = "code") -> DataFrame:
    """A row per diagnostic of each code text; a null text, or one without errors, has none.  Equal texts are looked at once a task, while they are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        told = lru_cache(maxsize=10_000)(diagnose)
        for b in batches:
            rows = [(k, *d) for k, t in zip(b[key], b[text], strict=True) if t is not None for d in told(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return code.select(key, text).mapInPandas(run, f"{key} {dict(code.dtypes)[key]}, {SCHEMA}")
