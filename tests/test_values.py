"""The loose types against a model in plain Python, on all pairs of a set of values."""

import json
import math

import pytest

from tarn.engine import Engine

#: Objects have their keys in order, as objects made by coalesce print them.
VALUES = [None, True, False, 0, 1, 2, -1, 7, 0.5, 1.0, 2.5, "", "1", "1.0", "2", "a", "B", "true", "FALSE", " 3 ", "Infinity", "inf", "nan", [], [1], ["x", 2], {}, {"k": 1}, {"1.0": 5, "K": "v"}]


def number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        if v.strip().lower() in ("inf", "nan", "infinity") and v.strip() not in ("Infinity", "NaN"):
            return None
        try:
            return float(v)
        except ValueError:
            return None
    return None


def boolean(v):
    if isinstance(v, bool):
        return v
    return {"true": True, "false": False}.get(v.lower()) if isinstance(v, str) else None


def text(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(float(v)).replace("inf", "Infinity").replace("nan", "NaN")
    return json.dumps(v, separators=(",", ":"))


def compare(a, b):
    """-1, 0, 1 or None."""
    if a is None or b is None:
        return None
    numbers = [isinstance(v, (int, float)) and not isinstance(v, bool) for v in (a, b)]
    if not all(numbers):
        a, b = (str(v) if isinstance(v, int) and not isinstance(v, bool) else text(v) for v in (a, b))
    return (a > b) - (a < b)


def element(a, k):
    if a is None or k is None:
        return None
    if isinstance(a, dict):
        return {x.lower(): y for x, y in a.items()}.get(text(k))
    many, n = a if isinstance(a, list) else [a], number(k)
    if n is None or math.isinf(n) or n <= -1:
        return None
    return many[int(n)] if int(n) < len(many) else None


def strict(of):
    def run(a, b):
        p, q = boolean(a), boolean(b)
        return None if p is None or q is None else of(p, q)

    return run


def arithmetic(of):
    def run(a, b):
        x, y = number(a), number(b)
        return None if x is None or y is None else of(x, y)

    return run


def divide(x, y):
    return x / y if y else math.nan if x == 0 or math.isnan(x) else math.copysign(math.inf, x)


def test(of):
    return lambda a, b: None if (c := compare(a, b)) is None else of(c)


test.__test__ = False
MODEL = {
    "a = b": test(lambda c: c == 0),
    "a != b": test(lambda c: c != 0),
    "a < b": test(lambda c: c < 0),
    "a <= b": test(lambda c: c <= 0),
    "a > b": test(lambda c: c > 0),
    "a >= b": test(lambda c: c >= 0),
    "a and b": strict(lambda p, q: p and q),
    "a or b": strict(lambda p, q: p or q),
    "a + b": arithmetic(lambda x, y: x + y),
    "a - b": arithmetic(lambda x, y: x - y),
    "a * b": arithmetic(lambda x, y: x * y),
    "a / b": arithmetic(divide),
    "a[b]": element,
    "coalesce(a, b)": lambda a, b: b if a is None else a,
    "a is null": lambda a, b: a is None,
    "number(a)": lambda a, b: number(a),
}


@pytest.mark.parametrize("promote", [True, False])
def test_all_pairs(spark, tmp_path, promote):
    pairs = [(a, b) for a in VALUES for b in VALUES]
    path = tmp_path / "pairs.json"
    path.write_text("\n".join(json.dumps({"i": i, "a": a, "b": b}) for i, (a, b) in enumerate(pairs)))
    names = list(MODEL)
    rows = Engine(spark, promote=promote).text(f"select i, {', '.join(f'{e} as c{j}' for j, e in enumerate(names))} from json '{path}' order by i;").collect()
    assert len(rows) == len(pairs)
    wrong = [(e, a, b, got, text(MODEL[e](a, b))) for (a, b), r in zip(pairs, rows, strict=True) for e, got in zip(names, r[1:], strict=True) if got != text(MODEL[e](a, b))]
    assert not wrong, (len(wrong), wrong[:20])
