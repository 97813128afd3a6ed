"""Override rules: a compiler from a small language to columns, fitness, ranking and application.

A rule is the body of `apply_rule_patch(svm_prob, features)`: `if` statements over comparisons of numbers,
`features.get(name, default)` and `math` functions, which return -1 (pass), 0 or 1. Texts are parsed, never run; a
construct outside the list is an error. Anything undefined at run time (null, division by zero) is a pass.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from palletry.operators.metrics import count_if

_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
_MATH = {"sqrt": F.sqrt, "log": F.ln, "exp": F.exp, "fabs": F.abs, "floor": F.floor, "ceil": F.ceil, "log1p": F.log1p}
EPS = 1e-6


class RuleError(ValueError):
    """A rule text outside the supported language."""


class _Compiler:
    def __init__(self, columns: Sequence[str], prob: str):
        self.columns, self.prob = set(columns), prob

    def value(self, node: ast.expr, names: Mapping[str, Column]) -> Column:
        match node:
            case ast.Constant(value=bool() | int() | float() as v):
                return F.lit(v if isinstance(v, bool) else float(v))
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.Call(func=ast.Attribute(value=ast.Name(id="features"), attr="get"), args=[ast.Constant(value=str(name)), *rest]):
                default = self.value(rest[0], names) if rest else F.lit(None).cast("double")
                return F.col(f"`{name}`").cast("double") if name in self.columns else default
            case ast.Subscript(value=ast.Name(id="features"), slice=ast.Constant(value=str(name))):
                return F.col(f"`{name}`").cast("double") if name in self.columns else F.lit(None).cast("double")
            case ast.Call(func=ast.Attribute(value=ast.Name(id="math"), attr=f), args=[x]) if f in _MATH:
                return _MATH[f](self.value(x, names)).cast("double")
            case ast.Call(func=ast.Name(id="abs"), args=[x]):
                return F.abs(self.value(x, names))
            case ast.Call(func=ast.Name(id="min" | "max" as f), args=[_, _, *_] as xs):
                return (F.least if f == "min" else F.greatest)(*[self.value(x, names) for x in xs])
            case ast.Call(func=ast.Name(id="float"), args=[x]):
                return self.value(x, names)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -self.value(x, names)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~self.value(x, names)
            case ast.BoolOp(op=op, values=[first, *rest]):
                out = self.value(first, names)
                for x in rest:
                    out = (out & self.value(x, names)) if isinstance(op, ast.And) else (out | self.value(x, names))
                return out
            case ast.BinOp(left=a, op=op, right=b):
                x, y = self.value(a, names), self.value(b, names)
                match op:
                    case ast.Add():
                        return x + y
                    case ast.Sub():
                        return x - y
                    case ast.Mult():
                        return x * y
                    case ast.Div():
                        return F.try_divide(x, y)
                    case ast.Pow():
                        return F.pow(x, y)
            case ast.Compare(left=left, ops=ops, comparators=others):
                parts, at = None, self.value(left, names)
                for op, other in zip(ops, others):
                    if type(op) not in _COMPARE:
                        raise RuleError(ast.dump(op))
                    right = self.value(other, names)
                    one = getattr(at, _COMPARE[type(op)])(right)
                    parts, at = one if parts is None else parts & one, right
                return parts
        raise RuleError(ast.unparse(node))

    def block(self, body: list[ast.stmt], names: dict[str, Column], after: Column) -> Column:
        """The result of some statements; `after` is that of what follows them. An undefined condition is a pass."""
        if not body:
            return after
        head, *tail = body
        match head:
            case ast.Return(value=None):
                return F.lit(-1)
            case ast.Return(value=x):
                v = self.value(x, names).cast("int")
                return F.when(v.isin(0, 1), v).otherwise(-1)
            case ast.Assign(targets=[ast.Name(id=name)], value=x):
                return self.block(tail, names | {name: self.value(x, names)}, after)
            case ast.If(test=test, body=yes, orelse=no):
                rest = self.block(tail, names, after)
                on = self.value(test, names)
                return F.when(on.isNull(), -1).when(on, self.block(yes, names, rest)).otherwise(self.block(no, names, rest))
            case ast.Expr(value=ast.Constant()) | ast.Pass() | ast.Import(names=[ast.alias(name="math")]):
                return self.block(tail, names, after)
        raise RuleError(ast.unparse(head))


def compiled(code: str, columns: Sequence[str], prob: str = "prob") -> Column:
    """A rule's text as a column of -1, 0 and 1."""
    try:
        found = [n for n in ast.parse(code).body if isinstance(n, ast.FunctionDef) and n.name == "apply_rule_patch"]
    except SyntaxError as e:
        raise RuleError(str(e)) from None
    if not found:
        raise RuleError("no apply_rule_patch")
    c = _Compiler(columns, prob)
    return F.coalesce(c.block(found[0].body, {"svm_prob": F.col(prob)}, F.lit(-1)), F.lit(-1)).cast("int")


def fitness(cases: DataFrame, rules: Mapping[str, Column | None]) -> DataFrame:
    """(rule, fn_corr, fn_miss, fp_corr, fp_over, easy_overrides, raw_score, score) of all rules in one pass over cases.

    A rule that didn't compile (None) corrects nothing. The score is an F measure of corrected errors, less a tenth of
    the share of right answers that the rule overrides.
    """
    none = F.lit(-1)
    kind, easy = F.col("error_type"), F.col("error_type").isin("TN", "TP")
    out = {r: none if c is None else c for r, c in rules.items()}
    aggs = []
    for i, (_, c) in enumerate(out.items()):
        aggs += [
            count_if((kind == "FN") & (c == 1)).alias(f"a{i}"), count_if((kind == "FN") & (c != 1)).alias(f"b{i}"), count_if((kind == "FP") & (c == 0)).alias(f"c{i}"),
            count_if((kind == "FP") & (c != 0)).alias(f"d{i}"), count_if(easy & (c != -1)).alias(f"e{i}"),
        ]
    one = cases.agg(*aggs, count_if(easy).alias("easy"))
    names = ("fn_corr", "fn_miss", "fp_corr", "fp_over", "easy_overrides")
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("nth"), *[F.col(f"{k}{i}").alias(n) for k, n in zip("abcde", names)]) for i, r in enumerate(out)]
    t = one.select("easy", F.explode(F.array(*rows)).alias("x")).select("easy", "x.*")
    part = lambda good, bad: F.col(good) / (F.col(good) + F.col(bad) + EPS)
    f = lambda p: 2 * p * p / (p + p + EPS)
    raw = (f(part("fn_corr", "fn_miss")) + f(part("fp_corr", "fp_over"))) / 2
    penalty = F.greatest(1 - 0.1 * F.col("easy_overrides") / F.greatest("easy", F.lit(1)), F.lit(0.0))
    return t.withColumns({"raw_score": raw, "score": raw * penalty}).drop("easy")


def ranked(rules: DataFrame) -> DataFrame:
    """Rules with their rank: score, then corrections, then few overrides, then order of entry."""
    order = Window.orderBy(F.desc(F.round("score", 9)), F.desc(F.col("fn_corr") + F.col("fp_corr")), "easy_overrides", "nth")
    return rules.withColumn("rank", F.row_number().over(order))


def best_rules(ranks: DataFrame, rules: Mapping[str, Column], k: int = 3) -> list[Column]:
    """The k best rules of a table with rank, best first; k names come to the driver. A rule that isn't compiled is left out."""
    top = ranks.where(F.col("rank") <= k).orderBy("rank").select("rule").collect()
    return [rules[r.rule] for r in top if rules.get(r.rule) is not None]


def applied(cases: DataFrame, rules: Sequence[Column], pred: str = "pred") -> DataFrame:
    """`cases` with `hybrid`: the first rule's answer that isn't a pass, else the prediction."""
    minus = F.lit(-1)
    return cases.withColumn("hybrid", F.coalesce(*[F.nullif(r, minus) for r in rules], F.col(pred)))  # without rules, the prediction


def synthetic_probability(hybrid: str = "hybrid", pred: str = "pred", prob: str = "prob") -> Column:
    """Probabilities after rules: 0.95 or 0.05 where they changed the answer."""
    return F.when(F.col(hybrid) == F.col(pred), F.col(prob)).when(F.col(hybrid) == 1, 0.95).otherwise(0.05)


def first_row_mask(cases: DataFrame, key: str, row: str, condition: Column) -> DataFrame:
    """`cases` with `hard`: whether the row is the first of its key and some row of the key meets the condition."""
    own = Window.partitionBy(key)
    nth = F.row_number().over(own.orderBy(row))
    return cases.withColumn("hard", (nth == 1) & F.max(condition.cast("int")).over(own).cast("boolean"))
