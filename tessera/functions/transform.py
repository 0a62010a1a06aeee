"""Sandboxed column transformers: ``def transform(v)`` in a small part of Python, compiled to Columns.

Only the listed syntax compiles; anything else raises SecurityViolation before any data is
read.  No source text is ever executed.  Values have a kind, so that ``+``, ``len`` or truth mean what they mean
in Python; the kind of ``v`` is a parameter.  What Python answers with an exception is null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SecurityViolation(ValueError):
    pass


@dataclass(frozen=True)
class Val:
    """A column and what it holds: any, string, number, bool, decimal, date, timestamp, interval, array, map, json, match, binary or null."""

    column: Column
    kind: str = "any"
    item: str = "any"  # of an array; of a map's values; float where a number may be one
    match: tuple | None = None  # (text, pattern) of a match


def _no(what: object):
    raise SecurityViolation(f"{what} is not allowed")


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)), ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a, b)), ast.Pow: lambda a, b: F.pow(a, b), ast.BitAnd: lambda a, b: a.bitwiseAND(b), ast.BitOr: lambda a, b: a.bitwiseOR(b), ast.BitXor: lambda a, b: a.bitwiseXOR(b), ast.LShift: lambda a, b: F.expr("1L") * a * F.pow(F.lit(2), b).cast("long"), ast.RShift: lambda a, b: F.floor(a / F.pow(F.lit(2), b))}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_WHITE = r"(?U)^\s+|\s+$"
#: Format letters of strftime as date patterns.
_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a"}


def _pattern(fmt: str) -> str:
    out, literal, i = [], "", 0

    def flush():
        nonlocal literal
        if literal:
            out.append("'" + literal.replace("'", "''") + "'")
            literal = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] in _LETTERS:
                flush()
                out.append(_LETTERS[fmt[i + 1]])
            elif fmt[i + 1] == "%":
                literal += "%"
            else:
                _no("%" + fmt[i + 1])
            i += 2
        else:
            literal += fmt[i]
            i += 1
    flush()
    return "".join(out)


def _text(v: Val) -> Column:
    """str(v)."""
    if v.kind == "bool":
        return F.initcap(v.column.cast("string"))
    if v.kind == "date":
        return F.date_format(v.column, "yyyy-MM-dd")
    if v.kind == "timestamp":
        return _iso(v.column, " ")
    if v.kind == "number" and v.item == "float":
        _no("the text of a float without a format")
    return v.column.cast("string")


def _iso(ts: Column, between: str = "T") -> Column:
    part = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, f"yyyy-MM-dd'{between}'HH:mm:ss"), F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)))


def _truth(v: Val) -> Column:
    c = v.column
    if v.kind in ("bool", "match"):
        return F.coalesce(c, F.lit(False))
    if v.kind == "null":
        return F.lit(False)
    if v.kind == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if v.kind in ("number", "decimal"):
        return F.coalesce(c != 0, F.lit(False))
    if v.kind in ("array", "map"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if v.kind == "any":
        return F.coalesce(~c.cast("string").isin("", "0", "0.0", "false"), F.lit(False))
    return c.isNotNull()


def _padded(s: Column, n: Column, fill: Column, side: str) -> Column:
    room = F.greatest(F.lit(0), n - F.length(s))
    left = {"<": F.lit(0), ">": room, "^": F.floor(room / 2) + F.when((room % 2 == 1) & (n % 2 == 1), 1).otherwise(0)}[side]
    return F.concat(F.repeat(fill, left.cast("int")), s, F.repeat(fill, (room - left).cast("int")))


def _spec(v: Val, spec: str) -> Column:
    """format(v, spec) of the common specifications; others are refused."""
    m = re.fullmatch(r"(?:(.)?([<>^]))?(0)?(\d+)?(,)?(?:\.(\d+))?([dfsx%])?", spec) or _no(f"format {spec!r}")
    fill, side, zero, width, comma, digits, kind = m.groups()
    if kind in ("f", "%") or digits is not None and v.kind in ("number", "decimal"):
        n = int(digits or 6)
        x = v.column * 100 if kind == "%" else v.column
        text = F.format_number(x.cast("decimal(38,18)") if v.kind == "decimal" else x, n)
        text = text if comma else F.replace(text, F.lit(","), F.lit(""))
        text = F.concat(text, F.lit("%")) if kind == "%" else text
    elif comma:
        text = F.format_number(v.column, 0)
    elif kind == "x":
        text = F.concat(F.when(v.column < 0, "-").otherwise(""), F.lower(F.hex(F.abs(v.column))))
    elif digits is not None:
        text = F.substring(_text(v), 1, int(digits))
    else:
        text = _text(v)
    if width:
        if zero and not side:
            return _zfill(text, F.lit(int(width)))
        return _padded(text, F.lit(int(width)), F.lit(fill or " "), side or (">" if v.kind in ("number", "decimal") else "<"))
    return text


def _zfill(s: Column, n: Column) -> Column:
    sign = F.regexp_extract(s, "^([+-]?)", 1)
    return F.concat(sign, _padded(F.substring(s, F.length(sign) + 1, F.length(s)), n - F.length(sign), F.lit("0"), ">"))


def _quantized(x: Column, n: int, mode: str) -> Column:
    x = x.cast("decimal(38,18)")
    scale = F.lit(10**n).cast("decimal(20,0)")
    if mode == "ROUND_HALF_UP":
        x = F.round(x, n)
    elif mode == "ROUND_HALF_EVEN":
        x = F.bround(x, n)
    elif mode in ("ROUND_DOWN", "ROUND_UP"):
        whole = (F.floor if mode == "ROUND_DOWN" else F.ceil)(F.abs(x) * scale)
        x = F.when(x < 0, -whole).otherwise(whole) / scale
    else:
        _no(mode)
    return x.cast(f"decimal(38,{n})")


def _find(s: Column, p: Column) -> Column:
    return F.instr(s, p) - 1


def _rfind(s: Column, p: Column) -> Column:
    at = F.instr(F.reverse(s), F.reverse(p))
    return F.when(at > 0, F.length(s) - at - F.length(p) + 1).otherwise(-1)


def _count(s: Column, p: Column) -> Column:
    found = F.try_divide(F.length(s) - F.length(F.replace(s, p, F.lit(""))), F.length(p)).cast("long")
    return F.when(F.length(p) > 0, found).otherwise(F.length(s).cast("long") + 1)


def _replace(s: Column, a: Column, b: Column) -> Column:
    """An empty text stands between all characters and at both ends."""
    spread = F.aggregate(F.split(s, ""), F.lit(""), lambda out, c: F.concat(out, c, b))
    return F.when(F.length(a) > 0, F.replace(s, a, b)).otherwise(F.when(F.length(s) > 0, F.concat(b, spread)).otherwise(b))


def _large(c: Column) -> Column:
    """A character as the first of a word: of several letters (ß) only the first is large."""
    up = F.upper(c)
    return F.concat(F.substring(up, 1, 1), F.lower(F.substring(up, F.lit(2), F.length(up))))


def _strip(s: Column, chars: Column | None, ends: str) -> Column:
    if chars is not None:
        return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[ends](s, chars)
    return F.regexp_replace(s, {"both": _WHITE, "left": r"(?U)^\s+", "right": r"(?U)\s+$"}[ends], "")


def _split(s: Column, p: Column | None = None) -> Column:
    if p is None:
        return F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")
    quoted = F.concat(F.lit(r"\Q"), p, F.lit(r"\E"))
    return F.split(s, quoted, F.lit(-1))


def _else_null(at: Column) -> Column:
    return F.when(at >= 0, at)


#: Methods of strings: (result kind, function of the text and the arguments).
_STRING: dict[str, tuple[str, Callable]] = {
    "upper": ("string", F.upper), "lower": ("string", F.lower), "title": ("string", lambda s: _title(s)),
    "capitalize": ("string", lambda s: F.concat(_large(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))),
    "strip": ("string", lambda s, c=None: _strip(s, c, "both")), "lstrip": ("string", lambda s, c=None: _strip(s, c, "left")), "rstrip": ("string", lambda s, c=None: _strip(s, c, "right")),
    "replace": ("string", _replace), "startswith": ("bool", F.startswith), "endswith": ("bool", F.endswith),
    "find": ("number", _find), "rfind": ("number", _rfind), "index": ("number", lambda s, p: _else_null(_find(s, p))), "rindex": ("number", lambda s, p: _else_null(_rfind(s, p))), "count": ("number", _count),
    "zfill": ("string", _zfill), "ljust": ("string", lambda s, n, c=None: _padded(s, n, F.lit(" ") if c is None else c, "<")), "rjust": ("string", lambda s, n, c=None: _padded(s, n, F.lit(" ") if c is None else c, ">")), "center": ("string", lambda s, n, c=None: _padded(s, n, F.lit(" ") if c is None else c, "^")),
    "removeprefix": ("string", lambda s, p: F.when(F.startswith(s, p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s)), "removesuffix": ("string", lambda s, p: F.when(F.endswith(s, p) & (F.length(p) > 0), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s)),
    "isdigit": ("bool", lambda s: s.rlike(r"^[0-9]+$")), "isnumeric": ("bool", lambda s: s.rlike(r"^\p{N}+$")), "isalpha": ("bool", lambda s: s.rlike(r"^\p{L}+$")), "isalnum": ("bool", lambda s: s.rlike(r"^[\p{L}\p{N}]+$")), "isspace": ("bool", lambda s: s.rlike(r"(?U)^\s+$")), "isupper": ("bool", lambda s: (F.upper(s) == s) & s.rlike(r"\p{L}")), "islower": ("bool", lambda s: (F.lower(s) == s) & s.rlike(r"\p{L}")),
    "split": ("array:string", _split), "splitlines": ("array:string", lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, r"\r?\n$", ""), r"\r?\n"))),
    "join": ("string", lambda s, xs: _joined(s, xs)), "encode": ("binary", lambda s, *_: F.encode(s, "UTF-8")),
}


def _ascii(text: Column) -> Column:
    """JSON text with characters beyond ASCII escaped."""
    escaped = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    long = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(escaped(c))), "")
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(long)


def _title(s: Column) -> Column:
    """A letter after a letter is small, any other one large."""
    chars = F.split(s, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False)), F.lower(c)).otherwise(_large(c))), "")


def _joined(s: Column, xs: Column) -> Column:
    head = F.coalesce(F.try_element_at(xs, F.lit(1)), F.lit(""))
    return F.aggregate(F.slice(xs, F.lit(2), F.greatest(F.lit(0), F.size(xs) - 1)), head, lambda a, x: F.concat(a, s, x))


#: Attributes of dates and times.
_PARTS = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "microsecond": lambda c: F.date_format(c, "SSSSSS").cast("int")}
_NUMERIC = ("number", "decimal")


class _Compiler:
    def __init__(self, names: dict[str, Val]) -> None:
        self.names = names

    def block(self, body: list[ast.stmt]) -> Val:
        """The returned value; statements after an ``if`` follow both of its branches."""
        for i, s in enumerate(body):
            if isinstance(s, ast.Return):
                return self.value(s.value) if s.value else Val(F.lit(None), "null")
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                self.names[s.targets[0].id] = self.value(s.value)
            elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value:
                self.names[s.target.id] = self.value(s.value)
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                self.names[s.target.id] = self.value(ast.BinOp(ast.Name(s.target.id), s.op, s.value))
            elif isinstance(s, ast.If):
                yes = _Compiler(dict(self.names)).block([*s.body, *body[i + 1 :]])
                no = _Compiler(dict(self.names)).block([*s.orelse, *body[i + 1 :]])
                return self.choice(_truth(self.value(s.test)), yes, no)
            elif isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant):
                continue
            elif isinstance(s, ast.Expr) and self.change(s.value):
                continue
            else:
                _no(type(s).__name__)
        return Val(F.lit(None), "null")

    def change(self, e: ast.expr) -> bool:
        """``xs.append(x)``, ``xs.extend(ys)`` and ``d.update(e)`` give the name a new value."""
        if not (isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and isinstance(e.func.value, ast.Name) and len(e.args) == 1 and not e.keywords):
            return False
        name, method = e.func.value.id, e.func.attr
        own, arg = self.value(e.func.value), self.value(e.args[0])
        new = {("array", "append"): lambda: F.array_append(own.column, arg.column), ("array", "extend"): lambda: F.concat(own.column, arg.column), ("map", "update"): lambda: F.map_concat(F.map_filter(own.column, lambda k, _: ~F.map_contains_key(arg.column, k)), arg.column)}.get((own.kind, method))
        if new:
            self.names[name] = Val(new(), own.kind, own.item if own.item != "any" else arg.kind)
        return bool(new)

    @staticmethod
    def choice(test: Column, a: Val, b: Val) -> Val:
        first = a if a.kind != "null" else b
        return Val(F.when(test, a.column).otherwise(b.column), first.kind if b.kind in (first.kind, "null") or a.kind == "null" else "any", first.item)

    def value(self, e: ast.expr) -> Val:
        handler = getattr(self, "on_" + type(e).__name__.lower(), None)
        return handler(e) if handler else _no(ast.unparse(e))

    def on_constant(self, e):
        kinds = {bool: "bool", int: "number", float: "number", str: "string", type(None): "null", bytes: "binary"}
        return Val(F.lit(e.value), kinds.get(type(e.value)) or _no(ast.unparse(e)), "float" if isinstance(e.value, float) else "any")

    def on_name(self, e):
        return self.names[e.id] if e.id in self.names else _no(f"unknown name {e.id}")

    def on_binop(self, e):
        a, b = self.value(e.left), self.value(e.right)
        op, kinds = type(e.op), (a.kind, b.kind)
        if op is ast.Add and "string" in kinds:
            return Val(F.concat(_text(a), _text(b)), "string")
        if op is ast.Add and kinds == ("array", "array"):
            return Val(F.concat(a.column, b.column), "array", a.item)
        if op is ast.Mult and "string" in kinds:
            s, n = (a, b) if a.kind == "string" else (b, a)
            return Val(F.repeat(s.column, F.greatest(F.lit(0), n.column.cast("int"))), "string")
        if "interval" in kinds or a.kind in ("date", "timestamp") and b.kind in ("date", "timestamp"):
            return self.dates(op, a, b)
        if op not in _BINARY:
            _no(op.__name__)
        if "decimal" in kinds and op is not ast.Div:
            return Val(_BINARY[op](a.column.cast("decimal(38,10)"), b.column.cast("decimal(38,10)")), "decimal")
        if op is ast.Pow and all(isinstance(x, ast.Constant) and type(x.value) is int for x in (e.left, e.right)) and 0 <= e.right.value < 64 and abs(e.left.value ** e.right.value) < 1 << 63:
            return Val(F.lit(e.left.value**e.right.value), "number")
        floats = op in (ast.Div, ast.Pow) or "float" in (a.item, b.item)
        return Val(_BINARY[op](a.column, b.column), "decimal" if "decimal" in kinds else "number", "float" if floats else "any")

    def dates(self, op, a: Val, b: Val) -> Val:
        if a.kind in ("date", "timestamp") and b.kind in ("date", "timestamp") and op is ast.Sub:
            return Val((F.unix_micros(a.column.cast("timestamp")) - F.unix_micros(b.column.cast("timestamp"))).cast("long"), "interval")
        if a.kind == b.kind == "interval" and op in (ast.Add, ast.Sub):
            return Val(_BINARY[op](a.column, b.column), "interval")
        if a.kind == "interval" and op is ast.Add:
            a, b = b, a
        if a.kind in ("date", "timestamp") and b.kind == "interval" and op in (ast.Add, ast.Sub):
            at = F.timestamp_micros(_BINARY[op](F.unix_micros(a.column.cast("timestamp")), b.column))
            return Val(at.cast(a.kind), a.kind)
        return _no("this arithmetic of dates")

    def on_unaryop(self, e):
        x = self.value(e.operand)
        if isinstance(e.op, ast.Not):
            return Val(~_truth(x), "bool")
        return Val({ast.USub: lambda: -x.column, ast.UAdd: lambda: x.column, ast.Invert: lambda: F.bitwise_not(x.column)}[type(e.op)](), x.kind if x.kind in _NUMERIC else "number")

    def on_boolop(self, e):
        out, *rest = map(self.value, e.values)
        for v in rest:
            if out.kind == v.kind == "bool":
                a, b = _truth(out), _truth(v)
                out = Val(a & b if isinstance(e.op, ast.And) else a | b, "bool")
            else:
                out = self.choice(_truth(out), v, out) if isinstance(e.op, ast.And) else self.choice(_truth(out), out, v)
        return out

    def on_compare(self, e):
        left, out = self.value(e.left), None
        for op, right in zip(e.ops, e.comparators, strict=True):
            r = self.value(right)
            one = self.compared(op, left, r)
            out, left = one if out is None else out & one, r
        return Val(out, "bool")

    def compared(self, op, a: Val, b: Val) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if b.kind != "null":
                _no("is, except for None")
            missing = ~_truth(a) if a.kind == "match" else a.column.isNull()
            return missing if isinstance(op, ast.Is) else ~missing
        if isinstance(op, (ast.In, ast.NotIn)):
            hit = F.array_contains(b.column, a.column) if b.kind == "array" else F.map_contains_key(b.column, a.column) if b.kind == "map" else F.contains(b.column, a.column)
            return F.coalesce(hit, F.lit(False)) if isinstance(op, ast.In) else ~F.coalesce(hit, F.lit(False))
        x, y = a.column, b.column
        if {a.kind, b.kind} == {"date", "string"}:
            x, y = _text(a), _text(b)
        return _COMPARE[type(op)](x, y)

    def on_ifexp(self, e):
        return self.choice(_truth(self.value(e.test)), self.value(e.body), self.value(e.orelse))

    def on_joinedstr(self, e):
        parts = []
        for v in e.values:
            if isinstance(v, ast.FormattedValue):
                x = self.value(v.value)
                if v.conversion not in (-1, 115):
                    _no("a conversion other than !s")
                spec = v.format_spec and "".join(ast.literal_eval(p) if isinstance(p, ast.Constant) else _no("a computed format") for p in v.format_spec.values)
                parts.append(self.formatted(x, spec) if spec else F.coalesce(_text(x), F.lit("None")))
            else:
                parts.append(self.value(v).column)
        return Val(F.concat(*parts) if parts else F.lit(""), "string")

    @staticmethod
    def formatted(x: Val, spec: str) -> Column:
        if x.kind in ("date", "timestamp"):
            return F.date_format(x.column, _pattern(spec))
        return _spec(x, spec)

    def on_list(self, e):
        items = [self.value(x) for x in e.elts]
        return Val(F.array(*[x.column for x in items]), "array", items[0].kind if items else "any")

    on_tuple = on_list

    def on_set(self, e):
        v = self.on_list(e)
        return Val(F.array_distinct(v.column), "array", v.item)

    def on_dict(self, e):
        pairs = [(self.value(k), self.value(v)) for k, v in zip(e.keys, e.values, strict=True)]
        return Val(F.create_map(*[x.column for kv in pairs for x in kv]), "map", pairs[0][1].kind if pairs else "any")

    def bound(self, target: ast.expr, x: Column, item: str) -> _Compiler:
        """A compiler that knows the variable of a comprehension or lambda; pairs are unpacked."""
        if isinstance(target, ast.Name):
            return _Compiler(self.names | {target.id: Val(x, item)})
        if isinstance(target, ast.Tuple) and len(target.elts) == 2 and all(isinstance(t, ast.Name) for t in target.elts):
            kinds = item.split("+") if "+" in item else ["any", "any"]
            return _Compiler(self.names | {t.id: Val(x[f"_{i}"], kinds[i]) for i, t in enumerate(target.elts)})
        return _no(ast.unparse(target))

    def comprehension(self, e, element: ast.expr) -> Val:
        (g,) = e.generators if len(e.generators) == 1 else _no("several for")
        xs = self.array(self.value(g.iter))
        column, kind = xs.column, []
        for test in g.ifs:
            column = self.filtered(column, g.target, xs.item, test)

        def make(x):
            v = self.bound(g.target, x, xs.item).value(element)
            kind.append(v.kind)
            return v.column

        return Val(F.transform(column, make), "array", kind[0])

    def filtered(self, column: Column, target: ast.expr, item: str, test: ast.expr) -> Column:
        return F.filter(column, lambda x: _truth(self.bound(target, x, item).value(test)))

    def on_listcomp(self, e):
        return self.comprehension(e, e.elt)

    on_generatorexp = on_listcomp

    def on_setcomp(self, e):
        v = self.comprehension(e, e.elt)
        return Val(F.array_distinct(v.column), "array", v.item)

    def on_dictcomp(self, e):
        k, v = self.comprehension(e, e.key), self.comprehension(e, e.value)
        return Val(F.map_from_arrays(k.column, v.column), "map", v.item)

    @staticmethod
    def array(v: Val) -> Val:
        """What a loop over the value goes through."""
        if v.kind == "map":
            return Val(F.map_keys(v.column), "array", "string")
        if v.kind in ("string", "any"):
            return Val(F.filter(F.split(v.column, ""), lambda x: x != ""), "array", "string")
        return v if v.kind == "array" else _no(f"a loop over {v.kind}")

    def on_subscript(self, e):
        v = self.value(e.value)
        if isinstance(e.slice, ast.Slice):
            return self.sliced(v, e.slice)
        if v.kind == "json":
            key = ast.literal_eval(e.slice) if isinstance(e.slice, ast.Constant) else _no("a computed key")
            return Val(F.try_variant_get(v.column, f"$[{key}]" if isinstance(key, int) else f"$['{key}']", "string"), "string")
        at = self.value(e.slice).column
        if v.kind == "map":
            return Val(F.try_element_at(v.column, at), v.item)
        if v.kind == "array":
            return Val(F.try_element_at(v.column, F.when(at >= 0, at + 1).otherwise(at).cast("int")), v.item)
        n = F.length(v.column)
        return Val(F.when((at < n) & (at >= -n), F.substring(v.column, F.when(at >= 0, at + 1).otherwise(n + at + 1).cast("int"), F.lit(1))), "string")

    def sliced(self, v: Val, s: ast.Slice) -> Val:
        step = ast.literal_eval(s.step) if s.step else 1
        lo = ast.literal_eval(s.lower) if s.lower else None
        hi = ast.literal_eval(s.upper) if s.upper else None
        if step == -1 and lo is None and hi is None:
            return Val(F.reverse(v.column), v.kind if v.kind == "array" else "string", v.item)
        if step != 1:
            _no("a slice with this step")
        n = F.size(v.column) if v.kind == "array" else F.length(v.column)
        a = F.lit(0) if lo is None else F.least(F.lit(lo), n) if lo >= 0 else F.greatest(F.lit(0), n + lo)
        b = n if hi is None else F.least(F.lit(hi), n) if hi >= 0 else F.greatest(F.lit(0), n + hi)
        size = F.greatest(F.lit(0), b - a)
        return Val(F.slice(v.column, a + 1, size), "array", v.item) if v.kind == "array" else Val(F.substring(v.column, a + 1, size), "string")

    def on_attribute(self, e):
        if ast.unparse(e) == "timezone.utc":
            return Val(F.lit("UTC"), "zone")
        v = self.value(e.value)
        if v.kind in ("date", "timestamp") and e.attr in _PARTS:
            return Val(_PARTS[e.attr](v.column), "number")
        if v.kind == "interval" and e.attr in ("days", "seconds"):
            days = F.floor(v.column / 86_400_000_000)
            return Val(days if e.attr == "days" else F.floor((v.column - days * 86_400_000_000) / 1_000_000), "number")
        return _no(ast.unparse(e))

    def on_call(self, e):
        name = ast.unparse(e.func)
        if any(k.arg is None for k in e.keywords) or any(isinstance(a, ast.Starred) for a in e.args):
            _no(ast.unparse(e))
        handler = getattr(self, "call_" + name.replace(".", "_"), None) if name not in self.names else None
        if handler and (isinstance(e.func, ast.Name) or name.split(".")[0] in ("re", "json", "datetime", "date") and name.split(".")[0] not in self.names):
            return handler(e)
        if isinstance(e.func, ast.Attribute):
            return self.method(e)
        return _no(ast.unparse(e))

    # -- functions

    def args(self, e, least: int = 1, most: int = 1) -> list[Val]:
        if not least <= len(e.args) <= most or e.keywords:
            _no(ast.unparse(e))
        return [self.value(a) for a in e.args]

    def literal(self, e, i: int, name: str, default=None):
        """An argument that must be written out."""
        for k in e.keywords:
            if k.arg == name:
                return k.value.value if isinstance(k.value, ast.Constant) else ast.unparse(k.value)
        if i < len(e.args):
            return e.args[i].value if isinstance(e.args[i], ast.Constant) else ast.unparse(e.args[i])
        return default

    def call_str(self, e):
        (v,) = self.args(e)
        return Val(F.coalesce(_text(v), F.lit("None")), "string")

    def call_int(self, e):
        v, *base = self.args(e, 1, 2)
        if base:
            return Val(F.conv(v.column, self.literal(e, 1, "base"), 10).cast("long"), "number")
        return Val(v.column.cast("int").cast("long") if v.kind == "bool" else v.column.try_cast("long"), "number")

    def call_float(self, e):
        return Val(self.args(e)[0].column.try_cast("double"), "number", "float")

    def call_bool(self, e):
        return Val(_truth(self.args(e)[0]), "bool")

    def call_abs(self, e):
        (v,) = self.args(e)
        return Val(F.abs(v.column), v.kind if v.kind in _NUMERIC else "number")

    def call_len(self, e):
        (v,) = self.args(e)
        return Val(F.size(v.column) if v.kind in ("array", "map") else F.length(v.column), "number")

    def extreme(self, e, many, one):
        vs = self.args(e, 1, 50)
        if len(vs) == 1:
            xs = self.array(vs[0])
            return Val(one(xs.column), xs.item)
        return Val(many(*[v.column for v in vs]), vs[0].kind)

    def call_min(self, e):
        return self.extreme(e, F.least, F.array_min)

    def call_max(self, e):
        return self.extreme(e, F.greatest, F.array_max)

    def call_sum(self, e):
        (v,) = self.args(e)
        xs = self.array(v).column
        return Val(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double")), "number")

    def call_round(self, e):
        v, *n = self.args(e, 1, 2)
        digits = self.literal(e, 1, "ndigits", 0)
        if n and v.item == "float":
            _no("round of a float to digits, which goes by its binary value")
        out = F.bround(v.column, digits)
        return Val(out if n else out.cast("long"), "decimal" if v.kind == "decimal" and n else "number")

    def call_divmod(self, e):
        a, b = self.args(e, 2, 2)
        q = F.floor(F.try_divide(a.column, b.column))
        return Val(F.array(q, (a.column - b.column * q).cast("long")), "array", "number")

    def call_pow(self, e):
        a, b = self.args(e, 2, 2)
        return Val(F.pow(a.column, b.column), "number")

    def call_ord(self, e):
        return Val(F.ascii(self.args(e)[0].column), "number")

    def call_chr(self, e):
        return Val(F.chr(self.args(e)[0].column), "string")

    def based(self, e, prefix: str, base: int):
        n = self.args(e)[0].column.cast("long")
        digits = F.lower(F.conv(F.abs(n).cast("string"), 10, base))
        return Val(F.concat(F.when(n < 0, "-").otherwise(""), F.lit(prefix), digits), "string")

    def call_hex(self, e):
        return self.based(e, "0x", 16)

    def call_oct(self, e):
        return self.based(e, "0o", 8)

    def call_bin(self, e):
        return self.based(e, "0b", 2)

    def call_list(self, e):
        return self.array(self.args(e)[0])

    call_tuple = call_list

    def call_set(self, e):
        v = self.array(self.args(e)[0])
        return Val(F.array_distinct(v.column), "array", v.item)

    def call_dict(self, e):
        v = self.args(e)[0]
        return v if v.kind == "map" else Val(F.map_from_entries(v.column), "map") if v.kind == "array" else _no(ast.unparse(e))

    def call_reversed(self, e):
        v = self.array(self.args(e)[0])
        return Val(F.reverse(v.column), "array", v.item)

    def call_sorted(self, e):
        v = self.array(self.value(e.args[0]))
        reverse = bool(self.literal(e, 9, "reverse", False))
        if any(k.arg not in ("reverse",) for k in e.keywords):
            _no(ast.unparse(e))
        return Val(F.sort_array(v.column, not reverse), "array", v.item)

    def call_any(self, e):
        v = self.array(self.args(e)[0])
        return Val(F.exists(v.column, lambda x: _truth(Val(x, v.item))), "bool")

    def call_all(self, e):
        v = self.array(self.args(e)[0])
        return Val(F.forall(v.column, lambda x: _truth(Val(x, v.item))), "bool")

    def call_range(self, e):
        vs = [v.column.cast("long") for v in self.args(e, 1, 3)]
        lo, hi, step = (F.lit(0).cast("long"), vs[0], F.lit(1).cast("long")) if len(vs) == 1 else (*vs, *([F.lit(1).cast("long")] if len(vs) == 2 else []))
        empty = F.array().cast("array<long>")
        return Val(F.when((step > 0) & (lo < hi), F.sequence(lo, hi - 1, F.greatest(step, F.lit(1)))).when((step < 0) & (lo > hi), F.sequence(lo, hi + 1, F.least(step, F.lit(-1)))).otherwise(empty), "array", "number")

    def call_enumerate(self, e):
        v = self.array(self.args(e)[0])
        return Val(F.transform(v.column, lambda x, i: F.struct(i.alias("_0"), x.alias("_1"))), "array", f"number+{v.item}")

    def call_zip(self, e):
        a, b = map(self.array, self.args(e, 2, 2))
        n = F.least(F.size(a.column), F.size(b.column))
        pairs = F.zip_with(F.slice(a.column, F.lit(1), n), F.slice(b.column, F.lit(1), n), lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))
        return Val(pairs, "array", f"{a.item}+{b.item}")

    def mapped(self, e):
        f, xs = e.args if len(e.args) == 2 and not e.keywords else _no(ast.unparse(e))
        v = self.array(self.value(xs))
        if isinstance(f, ast.Lambda) and len(f.args.args) == 1:
            return v, lambda x: self.bound(ast.Name(f.args.args[0].arg), x, v.item).value(f.body)
        if isinstance(f, ast.Name):
            return v, lambda x: _Compiler(self.names | {"\0": Val(x, v.item)}).value(ast.Call(f, [ast.Name("\0")], []))
        return _no(ast.unparse(e))

    def call_map(self, e):
        v, f = self.mapped(e)
        kind = []

        def make(x):
            out = f(x)
            kind.append(out.kind)
            return out.column

        column = F.transform(v.column, make)
        return Val(column, "array", kind[0])

    def call_filter(self, e):
        v, f = self.mapped(e)
        return Val(F.filter(v.column, lambda x: _truth(f(x))), "array", v.item)

    def call_isinstance(self, e):
        v, names = self.value(e.args[0]), ast.unparse(e.args[1]).strip("()").split(", ")
        kinds = {"str": ("string",), "int": ("number",), "float": ("number",), "bool": ("bool",), "list": ("array",), "dict": ("map",), "Decimal": ("decimal",), "datetime": ("timestamp",), "date": ("date", "timestamp"), "bytes": ("binary",)}
        known = set().union(*(kinds.get(n) or _no(n) for n in names))
        # the kind of ``any`` is not known before the data is
        return Val(v.column.isNotNull() if v.kind in known or v.kind == "any" else F.lit(False), "bool")

    # -- Decimal, dates, JSON and regular expressions

    def call_Decimal(self, e):  # noqa: N802
        return Val(self.args(e)[0].column.try_cast("decimal(38,18)"), "decimal")

    def call_timedelta(self, e):
        micros = {"days": 86_400_000_000, "hours": 3_600_000_000, "minutes": 60_000_000, "seconds": 1_000_000, "weeks": 604_800_000_000, "milliseconds": 1000, "microseconds": 1}
        parts = [("days", a) for a in e.args[:1]] + [(k.arg, k.value) for k in e.keywords]
        out = F.lit(0).cast("long")
        for name, v in parts:
            out = out + (self.value(v).column * (micros.get(name) or _no(name))).cast("long")
        return Val(out, "interval")

    def call_datetime_fromisoformat(self, e):
        return Val(F.try_to_timestamp(self.args(e)[0].column), "timestamp")

    def call_date_fromisoformat(self, e):
        return Val(self.args(e)[0].column.try_cast("date"), "date")

    def call_datetime_strptime(self, e):
        return Val(F.try_to_timestamp(self.value(e.args[0]).column, F.lit(_pattern(self.literal(e, 1, "format")))), "timestamp")

    def call_datetime_fromtimestamp(self, e):
        return Val(F.timestamp_seconds(self.value(e.args[0]).column), "timestamp")

    def call_datetime_now(self, e):
        return Val(F.current_timestamp(), "timestamp")

    call_datetime_utcnow = call_datetime_now

    def call_date(self, e):
        y, m, d = self.args(e, 3, 3)
        return Val(F.make_date(y.column, m.column, d.column), "date")

    def call_datetime(self, e):
        vs = [v.column for v in self.args(e, 3, 6)]
        vs += [F.lit(0)] * (6 - len(vs))
        return Val(F.try_make_timestamp(*vs), "timestamp")

    def call_json_loads(self, e):
        return Val(F.try_parse_json(self.args(e)[0].column), "json")

    def call_json_dumps(self, e):
        v = self.value(e.args[0])
        if v.kind in ("array", "map"):
            if ast.literal_eval(self.literal(e, 9, "separators", "None") or "None") != (",", ":"):
                _no("json.dumps of a container without separators=(',', ':')")
            return Val(_ascii(F.to_json(v.column)), "string")
        if v.kind == "json":
            return Val(_ascii(F.to_json(v.column)), "string")
        text = F.to_json(F.array(v.column))
        return Val(_ascii(F.coalesce(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("null"))), "string")

    def regex(self, e, flags_at: int) -> str:
        pattern = self.literal(e, 0, "pattern")
        if not isinstance(pattern, str) or not isinstance(e.args[0], ast.Constant):
            _no("a computed pattern")
        flags = str(self.literal(e, flags_at, "flags", ""))
        inline = "".join(f for name, f in (("I", "i"), ("M", "m"), ("S", "s")) if re.search(rf"re\.{name}\b", flags))
        try:
            re.compile(pattern)
        except re.error as x:
            _no(x)
        return f"(?U{inline})" + re.sub(r"\(\?P<", "(?<", pattern)

    def matched(self, e, form: str) -> Val:
        p = self.regex(e, 2)
        head, body = p[: p.index(")") + 1], p[p.index(")") + 1 :]
        p = head + form.format(body)
        s = self.value(e.args[1]).column
        return Val(F.coalesce(s.rlike(p), F.lit(False)), "match", match=(s, p))

    def call_re_match(self, e):
        return self.matched(e, "^(?:{})")

    def call_re_fullmatch(self, e):
        return self.matched(e, "^(?:{})\\z")

    def call_re_search(self, e):
        return self.matched(e, "{}")

    def call_re_sub(self, e):
        p, new = self.regex(e, 4), self.literal(e, 1, "repl")
        new = re.sub(r"\\g<(\w+)>", r"${\1}", re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$")))
        new = re.sub(r"\$\{(\d)\}", r"$\1", new)
        return Val(F.regexp_replace(self.value(e.args[2]).column, p, new), "string")

    def call_re_findall(self, e):
        p = self.regex(e, 2)
        groups = re.compile(self.literal(e, 0, "pattern")).groups
        if groups > 1:
            _no("findall with several groups")
        return Val(F.regexp_extract_all(self.value(e.args[1]).column, F.lit(p), F.lit(groups)), "array", "string")

    def call_re_split(self, e):
        return Val(F.split(self.value(e.args[1]).column, self.regex(e, 3), -1), "array", "string")

    # -- methods

    def method(self, e) -> Val:
        name, v = e.func.attr, self.value(e.func.value)
        if name == "isoformat":
            return Val(F.date_format(v.column, "yyyy-MM-dd") if v.kind == "date" else _iso(v.column), "string")
        own = getattr(self, f"{v.kind}_{name}", None)
        if own:
            return own(e, v)
        if v.kind in ("string", "any") and name in _STRING and not e.keywords:
            kind, f = _STRING[name]
            args = [self.value(a) for a in e.args]
            if name == "join":
                args = [self.array(args[0])]
            try:
                out = f(v.column, *[a.column for a in args])
            except TypeError:
                _no(ast.unparse(e))
            return Val(out, *kind.split(":"))
        if v.kind in ("string", "any") and name == "translate" and isinstance(e.args[0], ast.Call) and ast.unparse(e.args[0].func) == "str.maketrans":
            return Val(F.translate(v.column, *[ast.literal_eval(a) for a in e.args[0].args]), "string")
        if v.kind in ("string", "any") and name == "format" and isinstance(e.func.value, ast.Constant) and not e.keywords:
            return self.format_text(e)
        return _no(ast.unparse(e))

    def format_text(self, e) -> Val:
        import string

        parts, turn = [], 0
        for text, field, spec, conversion in string.Formatter().parse(e.func.value.value):
            parts.append(F.lit(text))
            if field is not None:
                if conversion or field and not field.isdigit():
                    _no(f"the field {field!r}")
                x = self.value(e.args[int(field) if field else turn])
                turn += 1
                parts.append(self.formatted(x, spec) if spec else F.coalesce(_text(x), F.lit("None")))
        return Val(F.concat(*parts), "string")

    def decimal_quantize(self, e, v):
        unit_ = e.args[0]
        if not (isinstance(unit_, ast.Call) and ast.unparse(unit_.func) == "Decimal" and isinstance(unit_.args[0], ast.Constant)):
            _no("quantize to a computed unit")
        n = len(str(unit_.args[0].value).partition(".")[2])
        return Val(_quantized(v.column, n, str(self.literal(e, 1, "rounding", "ROUND_HALF_EVEN")).rpartition(".")[2]), "decimal")

    def decimal_to_integral_value(self, e, v):
        return Val(_quantized(v.column, 0, str(self.literal(e, 0, "rounding", "ROUND_HALF_EVEN")).rpartition(".")[2]), "decimal")

    def decimal_compare(self, e, v):
        return Val(F.signum(v.column - self.args(e)[0].column.cast("decimal(38,18)")).cast("int"), "number")

    def timestamp_strftime(self, e, v):
        return Val(F.date_format(v.column, _pattern(self.literal(e, 0, "format"))), "string")

    date_strftime = timestamp_strftime

    def timestamp_weekday(self, e, v):
        return Val(F.weekday(v.column), "number")

    date_weekday = timestamp_weekday

    def timestamp_isoweekday(self, e, v):
        return Val(F.weekday(v.column) + 1, "number")

    date_isoweekday = timestamp_isoweekday

    def timestamp_date(self, e, v):
        return Val(v.column.cast("date"), "date")

    def timestamp_timestamp(self, e, v):
        return Val(F.unix_micros(v.column) / 1_000_000, "number")

    def timestamp_astimezone(self, e, v):
        return v if ast.unparse(e.args[0]) == "timezone.utc" else _no("a zone other than UTC")

    def timestamp_replace(self, e, v):
        keep = {k: f(v.column) for k, f in _PARTS.items()}
        for k in e.keywords:
            if k.arg == "tzinfo":
                continue
            keep[k.arg] = self.value(k.value).column if k.arg in keep else _no(k.arg)
        second = keep["second"] + keep["microsecond"] / F.lit(1_000_000).cast("decimal(10,0)")
        return Val(F.try_make_timestamp(keep["year"], keep["month"], keep["day"], keep["hour"], keep["minute"], second), "timestamp")

    def date_replace(self, e, v):
        keep = {k: f(v.column) for k, f in list(_PARTS.items())[:3]}
        for k in e.keywords:
            keep[k.arg] = self.value(k.value).column if k.arg in keep else _no(k.arg)
        return Val(F.make_date(keep["year"], keep["month"], keep["day"]), "date")

    def interval_total_seconds(self, e, v):
        return Val(v.column / 1_000_000, "number")

    def map_get(self, e, v):
        k, *default = self.args(e, 1, 2)
        found = F.try_element_at(v.column, k.column)
        return Val(F.when(F.map_contains_key(v.column, k.column), found).otherwise(default[0].column) if default else found, v.item)

    def map_keys(self, e, v):
        return Val(F.map_keys(v.column), "array", "string")

    def map_values(self, e, v):
        return Val(F.map_values(v.column), "array", v.item)

    def map_items(self, e, v):
        return Val(F.transform(F.map_entries(v.column), lambda x: F.struct(x["key"].alias("_0"), x["value"].alias("_1"))), "array", f"string+{v.item}")

    def map_copy(self, e, v):
        return v

    array_copy = map_copy

    def array_index(self, e, v):
        return Val(_else_null(F.array_position(v.column, self.args(e)[0].column) - 1), "number")

    def array_count(self, e, v):
        x = self.args(e)[0].column
        return Val(F.size(F.filter(v.column, lambda y: y == x)), "number")

    def json_get(self, e, v):
        key = ast.literal_eval(e.args[0])
        return Val(F.try_variant_get(v.column, f"$['{key}']", "string"), "string")

    def binary_decode(self, e, v):
        return Val(F.decode(v.column, "UTF-8"), "string")

    def match_group(self, e, v):
        s, p = v.match
        n = self.literal(e, 0, "group", 0)
        if isinstance(n, str):
            n = re.compile(p.replace("(?U", "(?").replace("(?)", "").replace("(?<", "(?P<").replace("\\z", "")).groupindex.get(n) or _no(n)
        return Val(F.when(v.column, F.regexp_extract(s, p, n)), "string")

    def match_groups(self, e, v):
        s, p = v.match
        n = re.compile(p.replace("(?U", "(?").replace("(?)", "").replace("(?<", "(?P<").replace("\\z", "")).groups
        return Val(F.when(v.column, F.array(*[F.regexp_extract(s, p, i + 1) for i in range(n)])), "array", "string")


def compile_transformer(source: str, value: Column, kind: str = "any") -> Column:
    """The column that ``def transform(v)`` makes of ``value``, which is of the given kind (see ``Val``)."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        raise SecurityViolation(str(e)) from None
    body = [s for s in tree.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
    if len(body) != 1 or not isinstance(body[0], ast.FunctionDef) or body[0].name != "transform" or len(body[0].args.args) != 1 or body[0].decorator_list:
        raise SecurityViolation("exactly one def transform(v) is allowed")
    f = body[0]
    try:
        return _Compiler({f.args.args[0].arg: Val(value, kind)}).block(f.body).column
    except SecurityViolation:
        raise
    except Exception as e:  # what the compiler has no form for, such as values of kinds that do not go together
        raise SecurityViolation(f"{type(e).__name__}: {e}") from e


#: Functions an expression of the SQL tier may call.
SQL_FUNCTIONS = frozenset("abs ceil coalesce concat date_format floor greatest if ifnull least length lower ltrim nullif nvl replace round rtrim substr substring to_date to_timestamp trim try_cast upper cast when and or in not is like between then else case end as int bigint string double decimal date timestamp boolean".split())
_SQL_TOKEN = re.compile(r"\s+|'(?:[^'\\]|'')*'|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_]*|[-+*/%=<>!(),|]")


def sql_case(expression: str, column: str) -> Column:
    """The SQL tier: an expression over ``legacy_col``, of literals, operators, CASE and the listed functions.

    Anything else, such as other columns, subqueries or comments, raises SecurityViolation; literals stay as they are.
    """
    out, at = [], 0
    while at < len(expression):
        m = _SQL_TOKEN.match(expression, at)
        if m is None or expression.startswith(("--", "/*"), at):
            raise SecurityViolation(f"{expression[at : at + 10]!r} is not allowed")
        word, at = m[0], m.end()
        if word == "legacy_col":
            word = "`" + column.replace("`", "``") + "`"
        elif re.match("[A-Za-z_]", word) and word.lower() not in SQL_FUNCTIONS and word.lower() not in ("null", "true", "false", "escape", "distinct", "from"):
            raise SecurityViolation(f"{word} is not allowed")
        out.append(word)
    return F.expr("".join(out))


#: The canonical transformers, by name.
SKETCHES = {
    "varchar_passthrough": lambda c: c,
    "strip": lambda c: F.regexp_replace(c, _WHITE, ""),
    "email_lower": lambda c: F.lower(F.regexp_replace(c, _WHITE, "")),
    "sentinel_to_null": lambda c: F.when(~c.isin("N/A", "NULL", "UNKNOWN", "", "-"), c),
    "date_to_timestamptz": lambda c: c.cast("date").cast("timestamp"),
    "timestamp_to_utc": lambda c: c.cast("timestamp"),
    "decimal_2dp": lambda c: F.round(c.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)"),
    "int_widen": lambda c: c.cast("long"),
    "int_narrow": lambda c: F.when(c.between(-2147483648, 2147483647), c.cast("int")),
    "to_bool": lambda c: F.when(F.lower(c.cast("string")).isin("1", "t", "true", "y", "yes"), True).when(F.lower(c.cast("string")).isin("0", "f", "false", "n", "no"), False),
    "json_parse": lambda c: F.try_parse_json(c),
    "json_dump": lambda c: F.to_json(F.struct(c.alias("v"))),
    "uuid_normalise": lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "[{}-]", "")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    "digits_only": lambda c: F.regexp_replace(c, "[^0-9]", ""),
    "bytes_passthrough": lambda c: c,
}


@dataclass(frozen=True)
class Rules:
    """Constraints of a target: a row that breaks one goes to quarantine with the first reason."""

    not_null: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    failed: tuple[tuple[str, str], ...] = ()  # (input column, output column): null out of a value


def quarantine_split(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``reason``: null for a row that may be written."""
    reason = F.lit(None).cast("string")
    if rules.key:
        from pyspark.sql.window import Window

        n = F.row_number().over(Window.partitionBy(*rules.key).orderBy(*df.columns))
        df = df.withColumn("_n", n)
        reason = F.when(F.col("_n") > 1, "target_constraint_violation")
    for c in rules.not_null:
        reason = F.coalesce(reason, F.when(F.col(c).isNull(), "target_constraint_violation"))
    for a, b in sorted(rules.failed):
        reason = F.coalesce(reason, F.when(F.col(a).isNotNull() & F.col(b).isNull(), "transform_error"))
    return df.withColumn("reason", reason).drop("_n")


def batch_id(migration: str, table: str, batch_no: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(migration), F.lit(table), batch_no.cast("string")), 256)


def batch_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    """batch_no by key order, without one task for all rows."""
    from ..operators.ordered import positions

    return positions(df, [], [key], "_i").withColumn("batch_no", F.floor(F.col("_i") / size)).drop("_i")
