"""Columns of the language's loose types.

A Val is a Column and what is known of its type when the query is planned. Where
the type is one of Spark's own, operations are plain Spark expressions that
Catalyst can fold, push down and compile. Values whose type is only known row by
row are VARIANT, and operations on them branch on the value's own type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that Spark reads as numbers and the language doesn't.
_NOT_NUMBERS = r"(?i)^[+-]?(inf|infinity|nan)$"
_NUMBER_NAMES = r"^[+-]?(Infinity|NaN)$"


@dataclass(frozen=True)
class Val:
    """kind: null, bool, int, double, string, array, struct, map, variant or other.

    literal: the value of a constant. path: for values of JSON records, the
    column of the record's text and the JSON path to this value in it, which is
    where objects and lists are printed from, with their keys in order.
    """

    col: Column
    kind: str
    dtype: T.DataType
    literal: object = None
    path: tuple[Column, str] | None = None


_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KINDS = ((T.NullType, "null"), (T.BooleanType, "bool"), (_INTS, "int"), ((T.FloatType, T.DoubleType, T.DecimalType), "double"), (T.StringType, "string"), (T.ArrayType, "array"), (T.StructType, "struct"), (T.MapType, "map"), (T.VariantType, "variant"))


def loose(dtype: T.DataType) -> bool:
    """Whether Spark can't order or group values of the type."""
    if isinstance(dtype, T.StructType):
        return any(loose(f.dataType) for f in dtype.fields)
    return loose(dtype.elementType) if isinstance(dtype, T.ArrayType) else isinstance(dtype, (T.VariantType, T.MapType))


def typed(col: Column, dtype: T.DataType, path: tuple[Column, str] | None = None) -> Val:
    kind = next((k for t, k in _KINDS if isinstance(dtype, t)), "other")
    if kind == "double" and not isinstance(dtype, T.DoubleType):
        col, dtype = col.cast("double"), T.DoubleType()
    return Val(col, kind, dtype, None, path)


def constant(value: object) -> Val:
    if value is None:
        return Val(null(), "null", T.NullType())
    kind, dtype = {bool: ("bool", T.BooleanType()), float: ("double", T.DoubleType()), str: ("string", T.StringType())}[type(value)]
    return Val(F.lit(value), kind, dtype, value)


def null(dtype: str = "string") -> Column:
    return F.lit(None).cast(dtype)


def kind_of(v: Column) -> Column:
    """bool, int, double, string, array or object of a VARIANT."""
    tag = F.schema_of_variant(v)
    return F.when(tag.startswith("OBJECT"), "object").when(tag.startswith("ARRAY"), "array").when(tag == "STRING", "string").when(tag == "BOOLEAN", "bool").when(tag == "BIGINT", "int").otherwise("double")


def get(v: Column, path: str, dtype: str) -> Column:
    return F.try_variant_get(v, path, dtype)


def present(v: Column) -> Column:
    """A VARIANT with JSON's null as SQL's."""
    return F.when(F.is_variant_null(v), None).otherwise(v)


def text_number(s: Column) -> Column:
    trimmed = F.trim(s)
    return F.when(trimmed.rlike(_NOT_NUMBERS) & ~trimmed.rlike(_NUMBER_NAMES), None).otherwise(s.try_cast("double"))


def number(a: Val) -> Column:
    """The value as a double: numbers and strings that spell one; else null."""
    if a.kind in ("int", "double"):
        return F.lit(a.literal) if a.literal is not None else a.col.cast("double")
    if a.kind == "string":
        return text_number(a.col)
    if a.kind == "variant":
        k = kind_of(a.col)
        return F.when(k.isin("int", "double"), get(a.col, "$", "double")).when(k == "string", text_number(get(a.col, "$", "string")))
    return null("double")


def boolean(a: Val) -> Column:
    """The value as a truth value: booleans and the words true and false; else null."""
    word = lambda s: F.when(F.lower(s) == "true", True).when(F.lower(s) == "false", False)
    if a.kind == "bool":
        return a.col
    if a.kind == "string":
        return word(a.col)
    if a.kind == "variant":
        k = kind_of(a.col)
        return F.when(k == "bool", get(a.col, "$", "boolean")).when(k == "string", word(get(a.col, "$", "string")))
    return null("boolean")


def _json(a: Val) -> Column:
    out = F.to_json(a.col, {"ignoreNullFields": "false"})
    return out if a.path is None else F.coalesce(F.get_json_object(*a.path), out)


def text(a: Val) -> Column:
    """The printed form: numbers as doubles, lists and objects as compact JSON."""
    if a.kind == "string":
        return a.col
    if a.kind in ("int", "double"):
        return a.col.cast("double").cast("string")
    if a.kind in ("array", "struct", "map"):
        return _json(a)
    if a.kind == "variant":
        k = kind_of(a.col)
        return F.when(k.isin("int", "double"), get(a.col, "$", "double").cast("string")).when(k.isin("string", "bool"), get(a.col, "$", "string")).otherwise(_json(a))
    return null() if a.kind == "null" else a.col.cast("string")


def spelling(a: Val) -> Column:
    """What a value of one kind is compared by with a value of another: whole numbers without a point."""
    if a.kind == "int":
        return a.col.cast("string")
    if a.kind == "variant":
        return F.when(kind_of(a.col) == "int", get(a.col, "$", "bigint").cast("string")).otherwise(text(a))
    return text(a)


def listed(a: Val) -> tuple[Column, T.DataType]:
    """The value as an array: lists as they are, null as null, anything else as a list of one."""
    if a.kind == "array":
        return a.col, a.dtype.elementType
    if a.kind == "variant":
        many = get(a.col, "$", "array<variant>")
        one = F.when(a.col.isNotNull(), F.array(a.col))
        return F.transform(F.when(kind_of(a.col) == "array", many).otherwise(one), present), T.VariantType()
    if a.kind == "null":
        return null("array<string>"), T.StringType()
    return F.when(a.col.isNotNull(), F.array(a.col)), a.dtype


def lifted(a: Val) -> Val:
    """The value as a VARIANT."""
    if a.kind == "variant":
        return a
    if a.kind == "null":
        return Val(null("variant"), "variant", T.VariantType())
    col = a.col.cast("string").cast("variant") if a.kind == "other" else F.to_variant_object(a.col) if a.kind in ("struct", "map", "array") else a.col.cast("variant")
    return Val(col, "variant", T.VariantType(), None, a.path)


def sort_key(a: Val) -> Column:
    """Something of a total order: numbers, then all else by text, for VARIANT and maps."""
    if a.kind == "variant":
        n = F.when(kind_of(a.col).isin("int", "double"), get(a.col, "$", "double"))
        return F.when(a.col.isNotNull(), F.struct(F.when(n.isNull(), 1).otherwise(0), n, F.when(n.isNull(), text(a))))
    return text(a) if a.kind == "null" or loose(a.dtype) else a.col


def group_key(a: Val) -> Column:
    """Something that is equal for equal values of one kind only, for VARIANT and maps."""
    if a.kind == "variant":
        return F.when(a.col.isNotNull(), F.struct(kind_of(a.col), F.when(kind_of(a.col).isin("array", "object"), F.to_json(a.col)).otherwise(spelling(a))))
    return F.to_json(a.col) if loose(a.dtype) else a.col


def json_path(*steps: str) -> str | None:
    """None where a step can't be written in a path."""
    if any("'" in s or "]" in s for s in steps):
        return None
    return "$" + "".join(f"['{s}']" for s in steps)


def under(a: Val, step: str) -> tuple[Column, str] | None:
    if a.path is None or "'" in step or "]" in step:
        return None
    return a.path[0], f"{a.path[1]}['{step}']"


def _position(key: Val) -> Column:
    n = number(key)
    return F.when(n >= 0, F.floor(n).try_cast("int")).when(n > -1, 0)


def _variant_key(v: Column, key: Column) -> Column:
    """A key of an object, whatever its case in the object: keys are lower-cased, the given one is not."""
    low = F.transform_keys(get(v, "$", "map<string,variant>"), lambda k, _: F.lower(k))
    return F.try_element_at(low, key)


def idx(a: Val, key: Val) -> Val:
    """``a[key]``: an object's value by lower-cased key, else an element of ``listed(a)``; null if there is none."""
    if a.kind == "null" or key.kind == "null":
        return constant(None)
    name = None
    if key.literal is not None:
        name = key.literal if isinstance(key.literal, str) else str(key.literal) if isinstance(key.literal, float) else str(key.literal).lower()
    if a.kind == "struct":
        return _member(a, key, name)
    if a.kind == "map":
        low = F.transform_keys(a.col, lambda k, _: F.lower(k.cast("string")))
        return typed(F.try_element_at(low, text(key)), a.dtype.valueType)
    if a.kind == "variant":
        if name is not None and name == name.lower() and re.fullmatch(r"[a-z_][a-z_0-9]*", name):
            found = F.coalesce(get(a.col, f"$.{name}", "variant"), F.when(kind_of(a.col) == "object", _variant_key(a.col, F.lit(name))))
            return Val(present(found), "variant", T.VariantType(), None, under(a, name))
        many, _ = listed(a)
        found = F.when(kind_of(a.col) == "object", _variant_key(a.col, text(key))).otherwise(F.get(many, _position(key)))
        return Val(present(found), "variant", T.VariantType())
    many, element = listed(a)
    return typed(F.get(many, _position(key)), element)


def _member(a: Val, key: Val, name: str | None) -> Val:
    fields: dict[str, T.StructField] = {}
    for f in a.dtype.fields:
        fields[f.name.lower()] = f
    if name is not None:
        f = fields.get(name)
        if f is None:
            return constant(None)
        member = a.col.getField(f.name)
        return typed(present(member) if isinstance(f.dataType, T.VariantType) else member, f.dataType, under(a, f.name))
    if not fields:
        return constant(None)
    own = [(low, typed(a.col.getField(f.name), f.dataType)) for low, f in fields.items()]
    own = own if len({v.dtype for _, v in own}) == 1 else [(low, lifted(v)) for low, v in own]
    out, k = None, text(key)
    for low, v in own:
        out = F.when(k == low, v.col) if out is None else out.when(k == low, v.col)
    return replace(own[0][1], col=out, path=None)
