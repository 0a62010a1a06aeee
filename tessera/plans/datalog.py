"""A stratified Datalog dialect compiled to DataFrame plans.

Rules are ``head(X, Y) :- body.``; facts have no body.  Upper-case or ``_``-leading names are
variables.  Bodies hold atoms, ``not`` atoms, comparisons and one aggregate
(``N = count(X)``).  Arithmetic is left-associative without precedence, as in the language.
Relations are sets of tuples with columns c0, c1, ...
"""

from __future__ import annotations

import operator
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Steps


class DatalogSyntaxError(ValueError):
    pass


class StratificationError(ValueError):
    pass


class DatalogTimeout(RuntimeError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    predicate: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Constraint:
    left: tuple  # operand, op, operand, ...
    op: str
    right: tuple


@dataclass(frozen=True)
class Aggregate:
    target: Var
    function: str
    over: Var


@dataclass
class Rule:
    head: Atom
    body: list[Atom] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    aggregate: Aggregate | None = None


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<s>"(?:[^"\\]|\\.)*")|(?P<n>\d+\.\d+|\d+)|(?P<w>[A-Za-z_]\w*)|(?P<o>:-|==|!=|<=|>=|[<>=+\-*/%(),.])')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DatalogSyntaxError(f"unexpected character at {at}: {text[at]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i = _tokens(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.t[self.i + k] if self.i + k < len(self.t) else ("", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if not kind or value is not None and got != value:
            raise DatalogSyntaxError(f"expected {value or 'more'}, got {got or 'the end'}")
        self.i += 1
        return got

    def term(self):
        kind, got = self.peek()
        if got == "-" and self.peek(1)[0] == "n":
            self.take()
            return -self.term()
        self.take()
        if kind == "s":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), got[1:-1])
        if kind == "n":
            return float(got) if "." in got else int(got)
        if kind == "w":
            return Var(got) if got[0].isupper() or got[0] == "_" else got
        raise DatalogSyntaxError(f"expected a term, got {got}")

    def atom(self, negated: bool = False) -> Atom:
        name = self.take()
        self.take("(")
        args = [self.term()]
        while self.peek()[1] == ",":
            self.take()
            args.append(self.term())
        self.take(")")
        return Atom(name, tuple(args), negated)

    def operand(self):
        """A term, or an expression in parentheses (a tuple)."""
        if self.peek() != ("o", "("):
            return self.term()
        self.take()
        inner = self.operands()
        self.take(")")
        return inner[0] if len(inner) == 1 else inner

    def operands(self) -> tuple:
        out = [self.operand()]
        while self.peek()[1] in ("+", "-", "*", "/", "%"):
            out += [self.take(), self.operand()]
        return tuple(out)

    def rule(self) -> Rule:
        r = Rule(self.atom())
        if self.peek()[1] == ":-":
            self.take()
            while True:
                kind, got = self.peek()
                nxt = self.peek(1)[1]
                if got == "not" and self.peek(1)[0] == "w":
                    self.take()
                    r.body.append(self.atom(True))
                elif kind == "w" and nxt == "(":
                    r.body.append(self.atom())
                elif kind == "w" and nxt == "=" and self.peek(2)[1] in ("count", "sum", "min", "max"):
                    if r.aggregate:
                        raise DatalogSyntaxError("one aggregate for each rule")
                    target = self.term()
                    self.take("=")
                    f = self.take()
                    self.take("(")
                    r.aggregate = Aggregate(target, f, self.term())
                    self.take(")")
                else:
                    left = self.operands()
                    op = self.take()
                    if op not in ("==", "!=", "<", "<=", ">", ">="):
                        raise DatalogSyntaxError(f"unexpected {op}")
                    r.constraints.append(Constraint(left, op, self.operands()))
                if self.peek()[1] != ",":
                    break
                self.take()
        self.take(".")
        bound = {a for x in r.body if not x.negated for a in x.args if isinstance(a, Var)}
        bound |= {x for c in r.constraints if c.op == "==" for side in (c.left, c.right) if len(side) == 1 for x in side if isinstance(x, Var)}
        if r.aggregate:
            bound.add(r.aggregate.target)
        for a in r.head.args:
            if isinstance(a, Var) and a not in bound:
                raise DatalogSyntaxError(f"unbound head variable {a.name}")
        return r


def parse(text: str) -> list[Rule]:
    p, rules = _Parser(text), []
    while p.peek()[0]:
        rules.append(p.rule())
    return rules


def stratify(rules: list[Rule]) -> dict[str, int]:
    """The stratum of each defined predicate; negation and aggregation need a lower one."""
    level = {r.head.predicate: 0 for r in rules}
    for _ in range(len(level) + 1):
        moved = False
        for r in rules:
            for a in r.body:
                if a.predicate in level:
                    need = level[a.predicate] + (a.negated or r.aggregate is not None)
                    if need > level[r.head.predicate]:
                        level[r.head.predicate] = need
                        moved = True
        if not moved:
            return level
    raise StratificationError("negation or aggregation inside a cycle")


def _operate(a: Column, op: str, b: Column) -> Column:
    if op == "%":
        return a - b * F.floor(a / b)
    return {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv}[op](a, b)


def _expression(side: tuple, have: set[Var]) -> Column | None:
    cols = []
    for x in side[::2]:
        if isinstance(x, tuple):
            if (inner := _expression(x, have)) is None:
                return None
            cols.append(inner)
            continue
        if isinstance(x, Var) and x not in have:
            return None
        cols.append(F.col(f"`{x.name}`") if isinstance(x, Var) else F.lit(x))
    return reduce(lambda acc, pair: _operate(acc, *pair), zip(side[1::2], cols[1:], strict=True), cols[0])


#: Time for a program unless another is given.  On a cluster a fixpoint takes jobs, not microseconds: pass what the data need.
BUDGET_MS = 600_000


class Engine:
    def __init__(self, spark: SparkSession, edb: dict[str, DataFrame], timeout_ms: int = BUDGET_MS) -> None:
        self.spark, self.relations = spark, {k: self._columns(v) for k, v in edb.items()}
        self.end = time.monotonic() + timeout_ms / 1000

    @staticmethod
    def _columns(df: DataFrame) -> DataFrame:
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).distinct()

    def _check(self) -> None:
        if time.monotonic() >= self.end:
            raise DatalogTimeout("the time budget is used up")

    def _atom(self, a: Atom, source: DataFrame) -> DataFrame | None:
        """Bindings of an atom's variables; none if its arity is not the relation's."""
        if len(a.args) != len(source.columns):
            return None
        first: dict[Var, int] = {}
        for i, x in enumerate(a.args):
            if not isinstance(x, Var):
                source = source.where(F.col(f"c{i}").eqNullSafe(F.lit(x)))
            elif x in first:
                source = source.where(F.col(f"c{i}").eqNullSafe(F.col(f"c{first[x]}")))
            else:
                first[x] = i
        return source.select(*[F.col(f"c{i}").alias(x.name) for x, i in first.items()]).distinct() if first else source.limit(1).select(F.lit(1).alias("_"))

    def _join(self, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns and c != "_"]
        if not shared:
            key = [F.lit(1).eqNullSafe(F.lit(1))]
            b = b.select(*[c for c in b.columns if c != "_" or "_" not in a.columns])
            return a.join(b if b.columns else b, key[0], how)
        b = b.toDF(*[f"{c}\u0001" if c in shared else c for c in b.columns])
        out = a.join(b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{c}\u0001`")) for c in shared], how)
        return out.select(*[c for c in out.columns if not c.endswith("\u0001")])

    def _rule(self, r: Rule, delta: dict[str, DataFrame] | None = None, at: int | None = None) -> DataFrame | None:
        """The head tuples of a rule; body atom ``at`` reads the last round's new tuples."""
        positive = [(i, a) for i, a in enumerate(r.body) if not a.negated]
        if any(a.predicate not in self.relations for _, a in positive):
            return None
        df, todo = None, list(positive)
        while todo:  # atoms that share variables with what is bound come first
            have = set(df.columns) if df is not None else set()
            pick = next((x for x in todo if have & {v.name for v in x[1].args if isinstance(v, Var)}), todo[0])
            todo.remove(pick)
            i, a = pick
            one = self._atom(a, delta[a.predicate] if i == at else self.relations[a.predicate])
            if one is None:
                return None
            df = one if df is None else self._join(df, one, "inner")
        if df is None:
            df = self.spark.range(1).select(F.lit(1).alias("_"))
        for a in (a for a in r.body if a.negated):
            if a.predicate in self.relations and (one := self._atom(a, self.relations[a.predicate])) is not None:
                df = self._join(df, one, "left_anti")
        have = {Var(c) for c in df.columns}
        rest = list(r.constraints)
        while True:
            for c in rest:
                if c.op == "==" and not r.aggregate:
                    for x, side in ((c.left, c.right), (c.right, c.left)):
                        if len(x) == 1 and isinstance(x[0], Var) and x[0] not in have and (e := _expression(side, have)) is not None:
                            df = df.withColumn(x[0].name, e)
                            have.add(x[0])
                            rest.remove(c)
                            break
                    else:
                        continue
                    break
            else:
                break
        for c in rest:
            left, right = _expression(c.left, have), _expression(c.right, have)
            if left is None or right is None:
                raise DatalogSyntaxError("a constraint has an unbound variable")
            df = df.where({"==": left.eqNullSafe(right), "!=": ~left.eqNullSafe(right), "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.op])
        if r.aggregate:
            keys = [a.name for a in r.head.args if isinstance(a, Var) and a != r.aggregate.target]
            v = F.col(f"`{r.aggregate.over.name}`")
            f = {"count": F.count(F.lit(1)), "sum": F.coalesce(F.sum(v), F.lit(0)), "min": F.min(v), "max": F.max(v)}[r.aggregate.function]
            df = df.distinct()
            df = (df.groupBy(*keys) if keys else df.groupBy()).agg(f.alias(r.aggregate.target.name))
        return df.select(*[(F.col(f"`{a.name}`") if isinstance(a, Var) else F.lit(a)).alias(f"c{i}") for i, a in enumerate(r.head.args)]).distinct()

    def run(self, rules: list[Rule], target: str) -> DataFrame | None:
        self._check()
        strata = stratify(rules)
        for level in sorted(set(strata.values())):
            own = [r for r in rules if strata[r.head.predicate] == level]
            names = {r.head.predicate for r in own}
            recursive = any(a.predicate in names for r in own for a in r.body)
            if not recursive:
                for name in sorted(names):
                    self._add(name, [x for r in own if r.head.predicate == name and (x := self._rule(r)) is not None])
                continue
            # semi-naive: each round joins the last round's new tuples with everything so far
            steps = Steps(self.spark.range(1))
            delta = {}
            for name in sorted(names):
                self._add(name, [x for r in own if r.head.predicate == name and not any(a.predicate in names for a in r.body) and (x := self._rule(r)) is not None])
            for name in [n for n in names if n in self.relations]:
                self.relations[name] = delta[name] = steps.put(self.relations[name])
            while delta:
                self._check()
                new: dict[str, DataFrame] = {}
                for r in own:
                    for i, a in enumerate(r.body):
                        if a.predicate in delta and not a.negated and (x := self._rule(r, delta, i)) is not None:
                            name = r.head.predicate
                            new[name] = new[name].union(x) if name in new else x
                delta = {}
                for name, df in new.items():
                    df = df.distinct()
                    if name in self.relations:
                        old = self.relations[name]
                        b = old.toDF(*[f"{c}\u0001" for c in old.columns])
                        df = df.join(b, [F.col(c).eqNullSafe(F.col(f"`{c}\u0001`")) for c in df.columns], "left_anti")
                    df = steps.put(df)
                    if not df.isEmpty():
                        delta[name] = df
                for name, df in delta.items():
                    self.relations[name] = self.relations[name].union(df) if name in self.relations else df
        return self.relations.get(target)

    def _add(self, name: str, parts: list[DataFrame]) -> None:
        if name in self.relations:
            parts = [self.relations[name], *parts]
        if parts:
            self.relations[name] = reduce(lambda a, b: a.union(b), parts).distinct() if len(parts) > 1 else parts[0]


def evaluate(spark: SparkSession, program: str, edb: dict[str, DataFrame], target: str, timeout_ms: int = BUDGET_MS) -> DataFrame | None:
    """The tuples of a predicate as a DataFrame; None if nothing defines it."""
    return Engine(spark, edb, timeout_ms).run(parse(program), target)
