"""Functions on Python source text. They parse it and never run it.

Parsing has no counterpart in SQL, so these are Arrow-batched UDFs; everything else stays in the JVM.
"""

from __future__ import annotations

import ast
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

#: What an instrumented suite prints before each part of a failed assertion.
GIVEN, GOT, WANTED, FAILED = "  Input:    ", "  Output:   ", "  Expected: ", "  Failed:   "

#: Results that are Python objects at a time.
PIECE = 256
_UNREADABLE = (SyntaxError, ValueError, MemoryError, RecursionError)


def _tree(source: str) -> ast.Module | None:
    """The parsed source; None if it does not parse."""
    try:
        return ast.parse(source)
    except _UNREADABLE:
        return None


def _fault(source: str) -> int | None:
    """The line, from 0, at which the parser stops (0 if it cannot say); None if all parses."""
    try:
        ast.parse(source)
    except SyntaxError as e:
        return max((e.lineno or 1) - 1, 0)
    except ValueError:
        return source[: max(source.find("\0"), 0)].count("\n")
    except (MemoryError, RecursionError):
        return 0
    return None


def largest_prefix(code: str) -> str:
    """The head of whole lines that is left when the lines from each fault on are taken away until the rest parses, without trailing white space.

    A fault in the first line, or past the last, takes the last line alone.
    """
    head = code.split("\n")
    while head and (at := _fault("\n".join(head))) is not None:
        del head[at if 0 < at < len(head) else -1 :]
    return "\n".join(head).rstrip()


def _mapped(node: ast.AST, rule: Callable[[ast.AST], ast.AST | list]) -> ast.AST | list:
    """The tree with each node replaced by what rule makes of it, children first; in a list of nodes, a rule may give several or none."""
    for field, old in ast.iter_fields(node):
        if isinstance(old, ast.AST):
            setattr(node, field, _mapped(old, rule))
        elif isinstance(old, list):
            new: list = []
            for x in old:
                y = _mapped(x, rule) if isinstance(x, ast.AST) else x
                new += y if isinstance(y, list) else [y]
            setattr(node, field, new)
    return rule(node)


def _own(node: ast.AST) -> ast.AST:
    """self.x as x."""
    match node:
        case ast.Attribute(value=ast.Name(id="self"), attr=attr, ctx=ctx):
            return ast.Name(attr, ctx)
    return node


def _freed(item: ast.stmt) -> list[ast.stmt]:
    """A member of a class as it stands outside: a function without self, an assignment; nothing else."""
    match item:
        case ast.FunctionDef(name="__init__") | ast.AsyncFunctionDef(name="__init__"):
            return []
        case ast.FunctionDef(args=args) | ast.AsyncFunctionDef(args=args):
            args.args = [a for i, a in enumerate(args.args) if i or a.arg != "self"]
            return [_mapped(item, _own)]
        case ast.Assign() | ast.AnnAssign():
            return [item]
    return []


def unwrap(code: str, name: str = "Solution") -> str:
    """The largest prefix that parses, in which the members of classes `name` stand at the top: functions without self, and assignments."""
    head = largest_prefix(code)
    tree = ast.parse(head)
    found = [isinstance(n, ast.ClassDef) and n.name == name for n in tree.body]
    if not any(found):
        return head if code.strip() else code
    tree.body = [x for n, wrapped in zip(tree.body, found) for x in (sum(map(_freed, n.body), []) if wrapped else [n])]
    return ast.unparse(ast.fix_missing_locations(tree))


def _called(node: ast.AST) -> set[str]:
    return {n.func.id for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}


def split_tests(suite: str, name: str) -> list[str]:
    """One complete suite for each statement of check(): all else at the top of the suite, check() with that statement alone, and its call.

    None for a blank suite or name, a suite that does not parse, or one without check().
    """
    tree = _tree(suite if name else "")
    check = next((n for n in (tree.body if tree else []) if isinstance(n, ast.FunctionDef) and n.name == "check"), None)
    if check is None:
        return []
    shared = [ast.unparse(n) for n in tree.body if n is not check]
    head = f"def check({ast.unparse(check.args)}):"
    body = lambda n: "\n".join("    " + line for line in ast.unparse(n).split("\n"))
    return ["\n".join([*shared, head, body(n), f"check({name})"]) for n in check.body]


def call_signature(tests: str, name: str) -> str:
    """`def name(...)` by the widest call of `candidate` in the tests, the first of these: variables and keywords by their names,
    other arguments by their places (arg0, ...). Empty without a call that has arguments."""
    tree = _tree(tests) if name else None
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "candidate"] if tree else []
    given = [[a.id if isinstance(a, ast.Name) else f"arg{i}" for i, a in enumerate(c.args)] + [k.arg for k in c.keywords if k.arg] for c in calls]
    widest = max(given, key=len, default=[])
    return f"def {name}({', '.join(widest)}):" if widest else ""


def definition_signature(code: str, name: str) -> str:
    """The header of the definition of `name`, or of the last function."""
    tree = _tree(code)
    found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)] if tree else []
    match = next((n for n in found if n.name == name), found[-1] if found else None)
    return f"def {match.name}({ast.unparse(match.args)}):" if match else ""


_TELL = f"""
def _tell(holds, claim, **parts):
    if not holds:
        for label, part in parts.items():
            print({{'given': {GIVEN!r}, 'got': {GOT!r}, 'wanted': {WANTED!r}, 'failed': {FAILED!r}}}[label] + part)
        raise AssertionError(claim)
"""


def _told(claim: ast.Assert, candidate: str | None) -> ast.stmt:
    """An assertion as a call of _tell, in which the two sides of a comparison, or the first two arguments of a helper, get names on the way."""
    source = ast.Constant(ast.unparse(claim.test))
    keep = lambda name, value: ast.NamedExpr(ast.Name(name, ast.Store()), value)
    seen = lambda name: ast.Call(ast.Name("repr", ast.Load()), [ast.Name(name, ast.Load())], [])
    match claim.test:
        case ast.Compare(left=got, ops=[ast.Eq()], comparators=[wanted]):
            holds: ast.expr = ast.Compare(keep("_got", got), [ast.Eq()], [keep("_wanted", wanted)])
        case ast.Call(func=func, args=[got, wanted, *more], keywords=named) if not any(isinstance(a, ast.Starred) for a in (got, wanted)):
            holds = ast.Call(func, [keep("_got", got), keep("_wanted", wanted), *more], named)
        case other:
            return ast.Expr(ast.Call(ast.Name("_tell", ast.Load()), [other, source], [ast.keyword("failed", source)]))
    call = next((n for n in ast.walk(got) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == candidate), None)
    parts = {"given": ast.Constant(", ".join(map(ast.unparse, call.args)))} if call else {}
    parts |= {"got": seen("_got"), "wanted": seen("_wanted")}
    return ast.Expr(ast.Call(ast.Name("_tell", ast.Load()), [holds, source], [ast.keyword(k, v) for k, v in parts.items()]))


def report(suite: str) -> str:
    """The suite with every assertion, at any depth, made to print before it raises AssertionError with its own source as message.

    `assert a == b` and `assert helper(a, b, ...)` print the representations of a and b, after the arguments, as written, of the
    call of check's first parameter in a, if there is one. Any other assertion prints itself. A suite that does not parse stays as it is.
    """
    tree = _tree(suite)
    if tree is None:
        return suite
    checks = [n for n in tree.body if isinstance(n, ast.FunctionDef) and n.name == "check" and n.args.args]
    candidate = checks[-1].args.args[0].arg if checks else None
    tree = _mapped(tree, lambda n: _told(n, candidate) if isinstance(n, ast.Assert) else n)
    first = next((i for i, n in enumerate(tree.body) if not (isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)) and not (isinstance(n, ast.ImportFrom) and n.module == "__future__")), len(tree.body))
    tree.body[first:first] = ast.parse(_TELL).body
    return ast.unparse(ast.fix_missing_locations(tree))


def meant(code: str, name: str) -> str:
    """The top-level function that `name` means: itself, the first that is the same but for case and _, else the last that no other calls, else the last; empty if there is none."""
    tree = _tree(code)
    functions = {n.name: n for n in (tree.body if tree else []) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    plain = lambda s: s.replace("_", "").lower()
    used = {x for n in functions.values() for x in _called(n) - {n.name}}
    choices = [[n for n in functions if n == name], [n for n in functions if plain(n) == plain(name)], [n for n in functions if n not in used][-1:], [*functions][-1:]]
    return next((c[0] for c in choices if c), "")


def alias(code: str, name: str) -> str:
    """The code with `name` bound to the function that it means, if that has another name."""
    target = meant(code, name) if name else ""
    return f"{code}\n{name} = {target}\n" if target and target != name else code


def _text(x: pa.Scalar) -> str | None:
    return x.as_py()


def _made(results: Iterator, kind: str) -> pa.Array:
    """Results as Arrow, converted by pieces of `PIECE`."""
    to = pa.list_(pa.string()) if kind == "array<string>" else pa.string()
    pieces = [pa.array(piece, to) for piece in iter(lambda: list(itertools.islice(results, PIECE)), [])]
    return pa.concat_arrays(pieces) if pieces else pa.array([], to)


def apply(f, *columns: str, kind: str = "string"):
    """f of one or two string columns as a column; null where the first is null.

    Texts become Python's one at a time, and results go to Arrow by pieces, so a worker holds its Arrow batch and little more.
    """

    @F.arrow_udf(kind)
    def one(a: pa.Array) -> pa.Array:
        return _made((None if x is None else f(x) for x in map(_text, a)), kind)

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return _made((None if x is None else f(x, y or "") for x, y in zip(map(_text, a), map(_text, b))), kind)

    return (one if len(columns) == 1 else two)(*columns)
