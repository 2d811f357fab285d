"""Prompt templates compiled to columns: slots, conditions, loops, filters and literals become expressions that Spark optimises; and a library of named prompts.

The grammar of expressions is Python's own, read by the standard library's parser; only the pipe of filters and the tilde of joins are rewritten before.
"""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, strip


class TemplateError(ValueError):
    """A template that the compiler does not take, or an unknown name in it."""


@dataclass(frozen=True)
class Value:
    """A column, or a value known already; kind is its type where that is known."""

    column: Column | None
    kind: T.DataType | None = None
    known: object = None

    @property
    def fixed(self) -> bool:
        return self.column is None

    def col(self) -> Column:
        if not self.fixed:
            return self.column
        if isinstance(self.known, (list, tuple)):
            return F.array(*[_value(x).col() for x in self.known])
        return F.lit(self.known)


_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def _value(x) -> Value:
    return x if isinstance(x, Value) else Value(None, _KINDS.get(type(x)), x)


def _array(v: Value) -> bool:
    return isinstance(v.kind, T.ArrayType) or isinstance(v.known, (list, tuple))


def _element(v: Value) -> T.DataType | None:
    return v.kind.elementType if isinstance(v.kind, T.ArrayType) else None


def text_of(v: Value) -> Column:
    """How a value is written: true and false with a capital, null as None, arrays as a list."""
    if v.fixed and not isinstance(v.known, (list, tuple)):
        return F.lit(str(v.known))
    c = v.col()
    if _array(v):
        quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'")) if isinstance(_element(v), T.StringType) else x.cast("string")
        return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]"))
    s = c.cast("string")
    s = F.initcap(s) if isinstance(v.kind, T.BooleanType) else s
    return F.coalesce(s, F.lit("None"))


def truth(v: Value) -> Column:
    """Empty texts and arrays, zero and null are false."""
    if v.fixed:
        return F.lit(bool(v.known))
    if _array(v):
        c = F.size(v.column) > 0
    elif isinstance(v.kind, T.BooleanType):
        c = v.column
    elif isinstance(v.kind, T.NumericType):
        c = v.column != 0
    elif isinstance(v.kind, (T.StructType, T.MapType)):
        c = v.column.isNotNull()
    else:
        c = v.column.cast("string") != ""
    return F.coalesce(c, F.lit(False))


_BLANKS = r"[\s\x1c-\x1f]"


def _strip(v, chars=None, left=True, right=True):
    if chars is None and left and right:
        return Value(strip(v.col()), T.StringType())
    some = f"(?U){_BLANKS}+" if chars is None else "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars.known) + "]+"
    ends = [rf"\A(?:{some})"] * left + [rf"(?:{some})\z"] * right
    return Value(F.regexp_replace(v.col(), "|".join(ends), ""), T.StringType())


def _string(f):
    return lambda v, *a: Value(f(v.col(), *[x.col() for x in a]), T.StringType())


def _index(v: Value, i: Value) -> Value:
    if isinstance(v.kind, T.StringType):
        at = i.col().cast("int")
        return Value(F.substring(v.col(), F.when(at >= 0, at + 1).otherwise(at), F.lit(1)), T.StringType())
    if isinstance(v.kind, T.MapType):
        return Value(F.try_element_at(v.col(), i.col()), v.kind.valueType)
    if v.fixed and i.fixed:
        return _value(v.known[i.known])
    at = i.col().cast("int")
    return Value(F.try_element_at(v.col(), F.when(at >= 0, at + 1).otherwise(at)), _element(v))


def _part(v: Value, start, stop) -> Value:
    """v[start:stop] of a text or an array, with places from the end below zero."""

    def of(c):
        n = F.length(c) if isinstance(v.kind, T.StringType) else F.size(c)
        place = lambda x, default: default if x is None else F.greatest(F.lit(0), F.least(n, F.when(x.col() < 0, n + x.col()).otherwise(x.col()))).cast("int")
        a, b = place(start, F.lit(0)), place(stop, n)
        long = F.greatest(b - a, F.lit(0))
        return F.substring(c, a + 1, long) if isinstance(v.kind, T.StringType) else F.slice(c, a + 1, long)

    return Value(let(v.col(), of), v.kind)


def _join(items: Value, by: Value) -> Value:
    return Value(F.call_function("array_join", F.transform(items.col(), lambda x: text_of(Value(x, _element(items)))), by.col()), T.StringType())


def _length(v):
    return Value((F.size(v.col()) if _array(v) else F.length(v.col())).cast("long"), T.LongType())


def _default(v, other=Value(None, T.StringType(), ""), when_false=Value(None, None, False)):
    c = F.when(truth(v), v.col()).otherwise(other.col()) if when_false.known else F.coalesce(v.col(), other.col())
    return Value(c, v.kind or other.kind)


def _split(v, by=None):
    if by is None:
        return Value(F.filter(F.split(v.col(), f"(?U){_BLANKS}+"), lambda w: w != ""), T.ArrayType(T.StringType()))
    return Value(F.split(v.col(), F.concat(F.lit(r"\Q"), by.col(), F.lit(r"\E")), -1), T.ArrayType(T.StringType()))


def _same(f):
    return lambda v: Value(f(v.col()), v.kind)


def _capital(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


METHODS: dict[str, Callable[..., Value]] = {
    "strip": _strip,
    "lstrip": lambda v, c=None: _strip(v, c, right=False),
    "rstrip": lambda v, c=None: _strip(v, c, left=False),
    "lower": _string(F.lower),
    "upper": _string(F.upper),
    "capitalize": _string(_capital),
    "title": _string(F.initcap),
    "replace": _string(F.replace),
    "split": _split,
    "join": lambda by, items: _join(items, by),
    "startswith": lambda v, x: Value(F.startswith(v.col(), x.col()), T.BooleanType()),
    "endswith": lambda v, x: Value(F.endswith(v.col(), x.col()), T.BooleanType()),
    "index": lambda v, x: Value((F.array_position(v.col(), x.col()) if _array(v) else F.instr(v.col(), x.col())) - 1, T.LongType()),
    "count": lambda v, x: Value((F.size(F.filter(v.col(), lambda y: y == x.col())) if _array(v) else F.size(F.split(v.col(), F.concat(F.lit(r"\Q"), x.col(), F.lit(r"\E")), -1)) - 1).cast("long"), T.LongType()),
}

FILTERS: dict[str, Callable[..., Value]] = {
    **{k: METHODS[k] for k in ("lower", "upper", "capitalize", "title", "replace")},
    "trim": _strip,
    "length": _length,
    "count": _length,
    "join": lambda v, by=Value(None, T.StringType(), ""): _join(v, by),
    "default": _default,
    "d": _default,
    "int": lambda v: Value(F.coalesce(v.col().try_cast("double").cast("long"), F.lit(0).cast("long")), T.LongType()),
    "float": lambda v: Value(F.coalesce(v.col().try_cast("double"), F.lit(0.0)), T.DoubleType()),
    "string": lambda v: Value(text_of(v), T.StringType()),
    "first": lambda v: _index(v, Value(None, None, 0)),
    "last": lambda v: _index(v, Value(None, None, -1)),
    "list": _same(lambda c: c),
    "sort": _same(F.array_sort),
    "unique": _same(F.array_distinct),
    "reverse": _same(F.reverse),
    "abs": _same(F.abs),
    "round": lambda v, n=Value(None, None, 0): Value(F.round(v.col(), n.known).cast("double"), T.DoubleType()),
    "regex_replace": lambda v, pattern, by=Value(None, T.StringType(), ""): Value(F.regexp_replace(v.col(), pattern.known, by.known), T.StringType()),
}

_PIECE = re.compile(r"\{#.*?#\}|\{\{-?\s*(?P<slot>.*?)\s*-?\}\}|\{%-?\s*(?P<tag>.*?)\s*-?%\}", re.S)
_CODE = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\|\s*(?P<filter>[A-Za-z_]\w*)\s*(?P<call>\()?|~", re.S)


def _parsed(code: str) -> ast.expr:
    """The syntax of an expression; x | f(a) becomes the method call that binds as tightly, and ~ a product."""

    def plain(m: re.Match) -> str:
        if m["filter"]:
            return f" .__filter_{m['filter']}({'' if m['call'] else ')'}"
        return "@" if m[0] == "~" else m[0]

    try:
        return ast.parse(_CODE.sub(plain, code).strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"not an expression: {code!r}") from e


_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: F.pmod(a, b) if isinstance(a, Column) else a % b, ast.FloorDiv: lambda a, b: F.floor(a / b) if isinstance(a, Column) else a // b}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def _evaluated(node: ast.expr, names: dict[str, Value]) -> Value:
    of = lambda x: _evaluated(x, names)
    match node:
        case ast.Constant(value=x) if x is None or isinstance(x, (str, int, float, bool)):
            return _value(x)
        case ast.Name(id=name):
            known = {"true": True, "false": False, "none": None}
            return names[name] if name in names else _value(known[name]) if name in known else _unknown(f"name {name!r}")
        case ast.List(elts=items) | ast.Tuple(elts=items):
            parts = [of(x) for x in items]
            if all(p.fixed for p in parts):
                return _value([p.known for p in parts])
            kind = next((p.kind for p in parts if not p.fixed), None)
            return Value(F.array(*[p.col() for p in parts]), T.ArrayType(kind) if kind else None)
        case ast.Attribute(value=x, attr=field):
            v = of(x)
            if isinstance(v.kind, T.StructType):
                if field not in v.kind.names:
                    raise TemplateError(f"unknown field {field!r}")
                return Value(v.column[field], v.kind[field].dataType)
            if isinstance(v.known, dict) and field in v.known:
                return _value(v.known[field])
            if v.kind is None and not v.fixed:
                return Value(v.column[field])
            return _index(v, _value(field)) if isinstance(v.kind, T.MapType) else _unknown(f"field {field!r}")
        case ast.Subscript(value=x, slice=ast.Slice(lower=a, upper=b, step=None)):
            return _part(of(x), a and of(a), b and of(b))
        case ast.Subscript(value=x, slice=i):
            v, at = of(x), of(i)
            return Value(v.column[at.known], v.kind[at.known].dataType) if isinstance(v.kind, T.StructType) and at.known in v.kind.names else _index(v, at)
        case ast.Call(func=ast.Attribute(value=x, attr=name), args=args, keywords=[]):
            if name.startswith("__filter_"):
                f = FILTERS.get(name[9:]) or _unknown(f"filter {name[9:]!r}")
            else:
                f = METHODS.get(name) or _unknown(f"method {name!r}")
            return f(of(x), *map(of, args))
        case ast.Call(func=ast.Name(id="range"), args=args, keywords=[]) if all(of(a).fixed for a in args):
            return _value(list(range(*[of(a).known for a in args])))
        case ast.BinOp(left=a, op=ast.MatMult(), right=b):
            return Value(F.concat(text_of(of(a)), text_of(of(b))), T.StringType())
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _ARITHMETIC:
            a, b = of(a), of(b)
            if a.fixed and b.fixed:
                return _value(_ARITHMETIC[type(op)](a.known, b.known))
            if isinstance(op, ast.Add) and isinstance(a.kind or b.kind, T.StringType):
                return Value(F.concat(a.col(), b.col()), T.StringType())
            if isinstance(op, ast.Add) and (_array(a) or _array(b)):
                return Value(F.concat(a.col(), b.col()), a.kind if not a.fixed else b.kind)
            whole = all(isinstance(x.kind, T.IntegralType) for x in (a, b)) and not isinstance(op, ast.Div)
            c = _ARITHMETIC[type(op)](a.col(), b.col())
            return Value(c.cast("long") if whole else c, T.LongType() if whole else T.DoubleType())
        case ast.UnaryOp(op=ast.USub(), operand=x):
            v = of(x)
            return _value(-v.known) if v.fixed else Value(-v.column, v.kind)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return Value(~truth(of(x)), T.BooleanType())
        case ast.BoolOp(op=op, values=parts):
            out = of(parts[-1])
            for p in map(of, parts[-2::-1]):  # the value itself, as in Python
                first, second = (out, p) if isinstance(op, ast.And) else (p, out)
                out = Value(F.when(truth(p), first.col()).otherwise(second.col()), out.kind if out.kind == p.kind else T.BooleanType())
            return out
        case ast.IfExp(test=t, body=a, orelse=b):
            t, a, b = of(t), of(a), of(b)
            return (a if t.known else b) if t.fixed else Value(F.when(truth(t), a.col()).otherwise(b.col()), a.kind or b.kind)
        case ast.Compare(left=a, ops=ops, comparators=rest):
            out, left = None, a
            for op, right in zip(ops, rest):
                c = _compared(left, op, right, names)
                out, left = c if out is None else out & c, right
            return Value(out, T.BooleanType())
    raise TemplateError(f"unsupported: {ast.unparse(node)}")


def _unknown(what: str):
    raise TemplateError(f"unknown {what}")


def _compared(left: ast.expr, op: ast.cmpop, right: ast.expr, names: dict[str, Value]) -> Column:
    if isinstance(op, (ast.Is, ast.IsNot)):  # tests: is defined, is none
        test = right.id if isinstance(right, ast.Name) else "none" if isinstance(right, ast.Constant) and right.value is None else None
        if isinstance(right, ast.UnaryOp) and isinstance(right.op, ast.Not):
            return ~_compared(left, op, right.operand, names)
        if test == "defined":
            c = F.lit(isinstance(left, ast.Name) and left.id in names or not isinstance(left, ast.Name))
        elif test == "none":
            c = _evaluated(left, names).col().isNull()
        else:
            _unknown(f"test {ast.unparse(right)!r}")
        return ~c if isinstance(op, ast.IsNot) else c
    a, b = _evaluated(left, names), _evaluated(right, names)
    if isinstance(op, (ast.In, ast.NotIn)):
        c = F.contains(b.col(), a.col()) if isinstance(b.kind, T.StringType) else F.array_contains(b.col(), a.col())
        c = F.coalesce(c, F.lit(False))
        return ~c if isinstance(op, ast.NotIn) else c
    c = _COMPARE[type(op)](a.col(), b.col())
    return F.coalesce(c, F.lit(isinstance(op, ast.NotEq)))


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, content): text, slot or tag, in order. A hyphen inside a mark takes the blanks beside it away; a line feed right after a tag goes not."""
    out, at, bare = [], 0, False
    for m in _PIECE.finditer(text):
        before = text[at : m.start()]
        before = before.lstrip() if bare else before
        before = before.rstrip() if m[0].startswith(("{{-", "{%-")) else before
        if before:
            out.append(("text", before))
        if m["slot"] is not None:
            out.append(("slot", m["slot"]))
        elif m["tag"] is not None:
            out.append(("tag", m["tag"]))
        at, bare = m.end(), m[0].endswith(("-}}", "-%}"))
    rest = text[at:].lstrip() if bare else text[at:]
    return out + ([("text", rest)] if rest else [])


_FOR, _SET = re.compile(r"for\s+([A-Za-z_]\w*)\s+in\s+(.*)\Z", re.S), re.compile(r"set\s+([A-Za-z_]\w*)\s*=\s*(.*)\Z", re.S)


def _until(parts: list, at: int, *ends: str) -> tuple[int, str]:
    """The place of the tag that ends, or parts, the block opened before at."""
    depth = 0
    for i in range(at, len(parts)):
        kind, code = parts[i]
        word = code.split()[0] if kind == "tag" and code else ""
        if depth == 0 and word in ends:
            return i, word
        depth += (word in ("if", "for")) - (word in ("endif", "endfor"))
    raise TemplateError(f"a block without {ends[-1]}")


def block(marks: list, names: dict[str, Value]) -> Column:
    names, parts, i = dict(names), [], 0
    while i < len(marks):
        kind, code = marks[i]
        i += 1
        if kind == "text":
            parts.append(F.lit(code))
        elif kind == "slot":
            parts.append(text_of(_evaluated(_parsed(code), names)))
        elif m := _SET.match(code):
            names[m[1]] = _evaluated(_parsed(m[2]), names)
        elif m := _FOR.match(code):
            end, _ = _until(marks, i, "endfor")
            parts.append(_loop(m[1], _evaluated(_parsed(m[2]), names), marks[i:end], names))
            i = end + 1
        elif code.split()[:1] == ["if"]:
            cases, test, word = [], code[2:], "if"
            while word != "endif":
                end, nxt = _until(marks, i, "elif", "else", "endif") if word != "else" else _until(marks, i, "endif")
                cases.append((None if word == "else" else truth(_evaluated(_parsed(test), names)), block(marks[i:end], names)))
                word, test, i = nxt, marks[end][1][4:], end + 1
            out = F.lit("")
            for test, body in reversed(cases):
                out = body if test is None else F.when(test, body).otherwise(out)
            parts.append(out)
        else:
            raise TemplateError(f"unsupported tag {code!r}")
    return F.concat(*parts) if parts else F.lit("")


def _loop(name: str, items: Value, body: list, names: dict[str, Value]) -> Column:
    """A known list is written out; an array becomes a transform, its texts joined."""
    long, flag = T.LongType(), T.BooleanType()
    if items.fixed:
        n = len(items.known)
        each = [block(body, names | {name: _value(x), "loop": _value({"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n})}) for i, x in enumerate(items.known)]
        return F.concat(*each) if each else F.lit("")

    def one(xs):
        def of(x, i):
            n = F.size(xs)
            place = F.struct((i + 1).cast("long").alias("index"), i.cast("long").alias("index0"), (i == 0).alias("first"), (i == n - 1).alias("last"), n.cast("long").alias("length"))
            kind = T.StructType([T.StructField("index", long), T.StructField("index0", long), T.StructField("first", flag), T.StructField("last", flag), T.StructField("length", long)])
            return block(body, names | {name: Value(x, _element(items)), "loop": Value(place, kind)})

        return F.array_join(F.transform(xs, of), "")

    return F.coalesce(let(items.col(), one), F.lit(""))


def _names(schema: T.StructType) -> dict[str, Value]:
    return {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in schema}


def compiled(text: str, schema: T.StructType) -> Column:
    """A text column for a template over rows of this schema. Names must be columns, or set in the template; else it is an error, at once and not on some row."""
    return block(pieces(text), _names(schema))


def field(spec, schema: T.StructType) -> Column:
    """A prompt's field: a column's name alone is that column, a template a text, a number itself, a list an array of templates; a slot alone keeps its value's type."""
    if isinstance(spec, (list, tuple)):
        return F.array(*[compiled(x, schema) if isinstance(x, str) else F.lit(x) for x in spec])
    if not isinstance(spec, str):
        return F.lit(spec)
    if spec in schema.names:
        return F.col(f"`{spec}`")
    parts = pieces(spec)
    if len(parts) == 1 and parts[0][0] == "slot":
        return _evaluated(_parsed(parts[0][1]), _names(schema)).col()
    return block(parts, _names(schema))


class PromptLibrary:
    """Named prompts, each a mapping of output columns to fields, looked up by group:name or a glob of it."""

    def __init__(self, prompts: dict[str, dict[str, object]]):
        self.prompts = dict(prompts)

    @classmethod
    def load(cls, path: str) -> "PromptLibrary":
        """A YAML file: group to name to prompt."""
        import yaml

        with open(path, encoding="utf-8") as f:
            groups = yaml.safe_load(f) or {}
        return cls({f"{g}:{n}": p for g, of in groups.items() for n, p in of.items()})

    def names(self, pattern: str = "*") -> list[str]:
        return sorted(fnmatch.filter(self.prompts, pattern))

    def apply(self, docs: DataFrame, name: str) -> DataFrame:
        """docs with the prompt's columns; these take the place of columns of their names."""
        if name not in self.prompts:
            raise TemplateError(f"no prompt {name!r}; there are {self.names()}")
        made = {k: field(spec, docs.schema) for k, spec in self.prompts[name].items()}
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[c.alias(k) for k, c in made.items()])

    def apply_all(self, docs: DataFrame, pattern: str) -> DataFrame:
        """A row for each document and prompt of the pattern, in one pass over docs; the prompts must make columns of the same names and types."""
        names = self.names(pattern)
        rows = F.array(*[F.struct(F.lit(n).alias("prompt_name"), *[field(spec, docs.schema).alias(k) for k, spec in self.prompts[n].items()]) for n in names])
        made = {k for n in names for k in self.prompts[n]} | {"prompt_name"}
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], F.inline(rows))
