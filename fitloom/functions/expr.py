"""Model expressions: one tree gives a Spark column, a SQL string, a numpy function and its derivatives."""

from __future__ import annotations

import ast
import math
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (numpy, column, sql)
UNARY = {
    "exp": (np.exp, F.exp, "exp({})"),
    "log": (np.log, F.log, "ln({})"),
    "sqrt": (np.sqrt, F.sqrt, "sqrt({})"),
    "sin": (np.sin, F.sin, "sin({})"),
    "cos": (np.cos, F.cos, "cos({})"),
    "atan": (np.arctan, F.atan, "atan({})"),
    "tanh": (np.tanh, F.tanh, "tanh({})"),
    "abs": (np.abs, F.abs, "abs({})"),
    "neg": (np.negative, lambda c: -c, "(-{})"),
    "sign": (np.sign, F.signum, "sign({})"),
}
BINARY = {
    "+": (np.add, lambda a, b: a + b, "({} + {})"),
    "-": (np.subtract, lambda a, b: a - b, "({} - {})"),
    "*": (np.multiply, lambda a, b: a * b, "({} * {})"),
    "/": (np.divide, lambda a, b: a / b, "({} / {})"),
    "^": (np.power, F.pow, "power({}, {})"),
    "min": (np.minimum, F.least, "least({}, {})"),
    "max": (np.maximum, F.greatest, "greatest({}, {})"),
    "lt": (np.less, lambda a, b: a < b, "({} < {})"),
}


@dataclass(frozen=True)
class Expr:
    """op is const, param, var, where or a key of UNARY or BINARY."""

    op: str
    args: tuple = ()
    value: object = field(default=None)

    def __add__(self, o):
        return make("+", self, o)

    def __radd__(self, o):
        return make("+", o, self)

    def __sub__(self, o):
        return make("-", self, o)

    def __rsub__(self, o):
        return make("-", o, self)

    def __mul__(self, o):
        return make("*", self, o)

    def __rmul__(self, o):
        return make("*", o, self)

    def __truediv__(self, o):
        return make("/", self, o)

    def __rtruediv__(self, o):
        return make("/", o, self)

    def __pow__(self, o):
        return make("^", self, o)

    def __neg__(self):
        return make("neg", self)

    def __lt__(self, o):
        return make("lt", self, o)


def const(x: float) -> Expr:
    return Expr("const", value=float(x))


def param(name: str) -> Expr:
    return Expr("param", value=name)


def var(name: str) -> Expr:
    return Expr("var", value=name)


def is_const(e: Expr, x: float | None = None) -> bool:
    return e.op == "const" and (x is None or e.value == x)


def make(op: str, *args) -> Expr:
    """A node, simplified where that cannot change a value."""
    a = tuple(x if isinstance(x, Expr) else const(x) for x in args)
    if all(x.op == "const" for x in a) and op in UNARY | BINARY and op != "lt":
        with np.errstate(all="ignore"):
            v = float((UNARY | BINARY)[op][0](*(x.value for x in a)))
        if math.isfinite(v):
            return const(v)
    if op == "+" and is_const(a[0], 0):
        return a[1]
    if op in "+-" and is_const(a[-1], 0) and len(a) == 2:
        return a[0]
    if op == "-" and is_const(a[0], 0):
        return make("neg", a[1])
    if op == "*":
        if is_const(a[0], 0) or is_const(a[1], 0):
            return const(0)
        if is_const(a[0], 1):
            return a[1]
        if is_const(a[1], 1):
            return a[0]
    if op == "/":
        if is_const(a[0], 0):
            return const(0)
        if is_const(a[1], 1):
            return a[0]
    if op == "^" and is_const(a[1], 1):
        return a[0]
    if op == "neg" and a[0].op == "neg":
        return a[0].args[0]
    return Expr(op, a)


def where(cond: Expr, yes, no) -> Expr:
    yes, no = (x if isinstance(x, Expr) else const(x) for x in (yes, no))
    return yes if yes == no else Expr("where", (cond, yes, no))


def fn(name: str):
    return lambda x: make(name, x)


exp, log, sqrt, sin, cos, atan, tanh, abs_ = (fn(n) for n in ("exp", "log", "sqrt", "sin", "cos", "atan", "tanh", "abs"))


def clip(e: Expr, lo: float, hi: float) -> Expr:
    return make("min", make("max", e, lo), hi)


@lru_cache(maxsize=4096)
def diff(e: Expr, name: str) -> Expr:
    """Derivative by the parameter or variable `name`."""
    if e.op in ("const", "param", "var"):
        return const(1.0 if e.op != "const" and e.value == name else 0.0)
    d = [diff(x, name) for x in e.args]
    a = e.args
    match e.op:
        case "+" | "-":
            return make(e.op, *d)
        case "*":
            return d[0] * a[1] + a[0] * d[1]
        case "/":
            return d[0] / a[1] - a[0] * d[1] / (a[1] * a[1])
        case "^":
            out = a[1] * make("^", a[0], a[1] - 1) * d[0]
            return out if is_const(d[1], 0) else out + e * log(a[0]) * d[1]
        case "neg":
            return -d[0]
        case "exp":
            return e * d[0]
        case "log":
            return d[0] / a[0]
        case "sqrt":
            return d[0] / (2 * e)
        case "sin":
            return cos(a[0]) * d[0]
        case "cos":
            return -(sin(a[0]) * d[0])
        case "atan":
            return d[0] / (1 + a[0] * a[0])
        case "tanh":
            return (1 - e * e) * d[0]
        case "abs":
            return make("sign", a[0]) * d[0]
        case "sign" | "lt":
            return const(0)
        case "min":
            return where(a[0] < a[1], d[0], d[1])
        case "max":
            return where(a[1] < a[0], d[0], d[1])
        case "where":
            return where(a[0], d[1], d[2])
    raise ValueError(e.op)


def names(e: Expr, kind: str) -> list:
    """Parameters or variables in the order of their first use."""
    out: dict = {}

    def walk(x):
        if x.op == kind:
            out[x.value] = True
        for y in x.args:
            walk(y)

    walk(e)
    return list(out)


def to_column(e: Expr, params: dict, columns: dict | None = None) -> Column:
    """Spark column; params: numbers or columns by name, columns: by variable (default: column of that name)."""
    memo: dict = {}

    def go(x):
        if x in memo:
            return memo[x]
        if x.op == "const":
            out = F.lit(x.value)
        elif x.op == "param":
            v = params[x.value]
            out = v if isinstance(v, Column) else F.lit(float(v))
        elif x.op == "var":
            v = (columns or {}).get(x.value, x.value)
            out = (v if isinstance(v, Column) else F.col(v)).cast("double")
        elif x.op == "where":
            c, yes, no = (go(y) for y in x.args)
            out = F.when(c, yes).otherwise(no)
        else:
            out = (UNARY | BINARY)[x.op][1](*(go(y) for y in x.args))
        memo[x] = out
        return out

    return go(e)


def to_sql(e: Expr, params: dict | None = None, columns: dict | None = None) -> str:
    """SQL text; params and columns: numbers or SQL by name (default: the names themselves)."""
    if e.op == "const":
        return f"{e.value!r}::DOUBLE"
    if e.op in ("param", "var"):
        v = ((params if e.op == "param" else columns) or {}).get(e.value, e.value)
        return f"{v!r}::DOUBLE" if isinstance(v, (int, float)) else str(v)
    a = [to_sql(x, params, columns) for x in e.args]
    if e.op == "where":
        return f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END"
    return (UNARY | BINARY)[e.op][2].format(*a)


def to_numpy(e: Expr):
    """f(params by name, variables by name) -> array."""

    def go(x, p, v):
        if x.op == "const":
            return x.value
        if x.op in ("param", "var"):
            return (p if x.op == "param" else v)[x.value]
        a = [go(y, p, v) for y in x.args]
        return np.where(*a) if x.op == "where" else (UNARY | BINARY)[x.op][0](*a)

    return lambda p, v: go(e, p, v)


def parse(text: str, variables: tuple = ("x",)) -> Expr:
    """A formula such as "a*exp(-b*x) + c": + - * / ** and the functions above, min, max, where(a < b, yes, no).

    Names in `variables` are data, all others parameters. Nothing else of Python is accepted.
    """
    ops = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "^"}

    def go(n):
        match n:
            case ast.Expression():
                return go(n.body)
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return const(v)
            case ast.Name(id="pi"):
                return const(math.pi)
            case ast.Name(id=i):
                return var(i) if i in variables else param(i)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -go(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return go(x)
            case ast.BinOp(op=op) if type(op) in ops:
                return make(ops[type(op)], go(n.left), go(n.right))
            case ast.Compare(ops=[ast.Lt()], comparators=[right]):
                return go(n.left) < go(right)
            case ast.Compare(ops=[ast.Gt()], comparators=[right]):
                return go(right) < go(n.left)
            case ast.Call(func=ast.Name(id="where"), args=[c, yes, no], keywords=[]):
                return where(go(c), go(yes), go(no))
            case ast.Call(func=ast.Name(id=f), args=[a], keywords=[]) if f in UNARY:
                return make(f, go(a))
            case ast.Call(func=ast.Name(id=f), args=[a, b], keywords=[]) if f in ("min", "max"):
                return make(f, go(a), go(b))
        raise ValueError(f"not part of a formula: {ast.unparse(n)}")

    try:
        return go(ast.parse(text.replace("^", "**"), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a formula: {text}") from e
