"""Chats with tools and schemas: an arithmetic tool without eval, the time, a bounded tool loop, validated replies."""

from __future__ import annotations

import ast
import json
import operator
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TWO = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_ONE = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def calculated(expression: str) -> float:
    """The value of an arithmetic expression: numbers, + - * / // % **, brackets. Anything else is a ValueError."""

    def value(node: ast.AST):
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _TWO:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
                raise ValueError("too large a power")
            return _TWO[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _ONE:
            return _ONE[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        return value(ast.parse(expression.strip(), mode="eval"))
    except (SyntaxError, ZeroDivisionError, OverflowError, RecursionError) as e:
        raise ValueError(str(e)) from e


def calculations(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``value``: what an arithmetic expression gives, null where it isn't one."""

    def one(x):
        try:
            return None if x is None else float(calculated(x))
        except (ValueError, OverflowError, TypeError):
            return None

    @F.pandas_udf("double")
    def values(texts):
        return texts.map(one).astype("float64")

    return rows.withColumn("value", values(F.col(column))).withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def current_time(zone=None) -> str:
    return datetime.now(zone).strftime("%Y-%m-%d %H:%M:%S")


TOOLS: dict[str, Callable[..., object]] = {"calculator": lambda expression: calculated(expression), "current_time": lambda: current_time()}


def tool_loop(model: Callable[[list[dict]], dict], question: str, tools: dict[str, Callable[..., object]] = TOOLS, most: int = 5) -> list[dict]:
    """A chat in which the model may call tools, ``most`` rounds long: the messages to its end.

    The model takes messages and gives one: content, and perhaps calls (id, name, arguments as
    JSON). An unknown tool, bad arguments and errors of a tool become the tool's message.
    """
    messages = [{"role": "user", "content": question}]
    for _ in range(most):
        reply = model(messages)
        messages.append({"role": "assistant", **reply})
        if not reply.get("calls"):
            break
        for call in reply["calls"]:
            try:
                result = str(tools[call["name"]](**json.loads(call.get("arguments") or "{}")))
            except KeyError:
                result = f"unknown tool: {call['name']}"
            except Exception as e:  # a tool's own: the model is told
                result = f"{type(e).__name__}: {e}"
            messages.append({"role": "tool", "call": call.get("id"), "content": result})
    return messages


def structured(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with ``value``: the JSON of a column in a schema; null where it isn't JSON or a field is missing or of another type."""
    kind = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    names = [f.split()[0] for f in schema.split(", ")]
    whole = kind.isNotNull()
    for name in names:
        whole = whole & kind[name].isNotNull()
    return rows.withColumn("value", F.when(F.coalesce(whole, F.lit(False)), kind))
