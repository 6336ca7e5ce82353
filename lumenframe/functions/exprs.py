"""Scalar and aggregate expressions with embedded-SQL semantics where Spark's defaults differ.

All of them are compositions of built-in functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- comparison and logic -------------------------------------------------------------------------------------------


def eq(a, b, optional: bool = False) -> Column:
    """``==``; null-safe when either side is optional, so it is then never null."""
    return col(a).eqNullSafe(col(b)) if optional else col(a) == col(b)


def neq(a, b, optional: bool = False) -> Column:
    return ~col(a).eqNullSafe(col(b)) if optional else col(a) != col(b)


def in_list(x: Column, values) -> Column:
    """An empty list holds nothing, not even null; a null in the list makes a miss unknown."""
    return x.isin(list(values)) if len(values) else F.lit(False)


def not_in_list(x: Column, values) -> Column:
    return ~x.isin(list(values)) if len(values) else F.lit(True)


def fold_and_or(ands, ors) -> Column:
    """All ``ands`` joined from the left, then all ``ors`` added: ((a AND b) OR c)."""
    parts = ([reduce(lambda x, y: x & y, ands)] if ands else []) + list(ors)
    return reduce(lambda x, y: x | y, parts) if parts else F.lit(True)


# --- pattern matching -----------------------------------------------------------------------------------------------


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE that ignores case in ASCII only. Without ``escape`` no character escapes."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    if escape is None:
        return ascii_lower(x).like(folded.replace("\\", "\\\\"))
    if len(escape) != 1:
        raise ValueError("an escape is a single character")
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape:
            if i + 1 == len(pattern):
                return F.when(x.isNotNull(), F.lit(False))
            i += 1
            c = pattern[i].translate(str.maketrans(UPPER, LOWER))
            out.append("\\" + c if c in "%_\\" else c)
        else:
            c = c.translate(str.maketrans(UPPER, LOWER))
            out.append("\\\\" if c == "\\" else c)
        i += 1
    return ascii_lower(x).like("".join(out))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a case-sensitive ``*``, ``?``, ``[...]`` pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))
            if end < 0:
                return "(?!)"
            inside = pattern[i + 1 : end]
            sign = "^" if inside.startswith("^") else ""
            body = inside[len(sign) :].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&")
            out.append(f"[{sign}{body}]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+(){}|]" else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


def regexp(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


# The collations by name.
COLLATIONS = {"binary": "UTF8_BINARY", "nocase": "UTF8_LCASE", "rtrim": "UTF8_BINARY_RTRIM"}


def collate(x: Column, name: str) -> Column:
    """binary, nocase (ASCII), rtrim, or any collation of the session by its own name."""
    if name == "nocase":
        return ascii_lower(x)  # a sort and comparison key: folds ASCII alone
    return F.collate(x, COLLATIONS.get(name, name))


# --- numbers --------------------------------------------------------------------------------------------------------


def int_div(a, b) -> Column:
    """Truncating division; by zero it is null."""
    return F.call_function("div", col(a).cast("bigint"), F.nullif(col(b).cast("bigint"), F.lit(0).cast("bigint")))


def int_mod(a, b) -> Column:
    return F.try_mod(col(a), col(b))


def real_div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), digits)


def scalar_min(*xs) -> Column:
    """Null if any argument is null."""
    xs = [col(x) for x in xs]
    return F.when(~reduce(lambda a, b: a | b, [x.isNull() for x in xs]), F.least(*xs))


def scalar_max(*xs) -> Column:
    xs = [col(x) for x in xs]
    return F.when(~reduce(lambda a, b: a | b, [x.isNull() for x in xs]), F.greatest(*xs))


# --- casts ----------------------------------------------------------------------------------------------------------


def text_to_int(x: Column) -> Column:
    """The longest integer prefix, or 0."""
    prefix = F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(x.isNotNull(), F.coalesce(F.expr("null").cast("bigint"), prefix.try_cast("bigint"), F.lit(0).cast("bigint")))


def text_to_real(x: Column) -> Column:
    """The longest number prefix, or 0.0."""
    prefix = F.regexp_extract(x, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(x.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def real_to_int(x: Column) -> Column:
    """Truncates; what is out of range becomes the nearest bound."""
    top = 9.223372036854775e18
    return F.when(x >= top, F.lit(2**63 - 1)).when(x <= -top, F.lit(-(2**63))).otherwise(F.when(~F.isnan(x), x).cast("bigint"))


# --- conditionals ---------------------------------------------------------------------------------------------------


def iif(cond: Column, then, otherwise) -> Column:
    """A null condition takes the other branch."""
    return F.when(cond, col(then)).otherwise(col(otherwise))


def case_simple(x: Column, branches, default=None) -> Column:
    return case_searched([(x == col(v), r) for v, r in branches], default)


def case_searched(branches, default=None) -> Column:
    out = None
    for cond, r in branches:
        out = F.when(cond, col(r)) if out is None else out.when(cond, col(r))
    return out if default is None else out.otherwise(col(default))


# --- strings and JSON -----------------------------------------------------------------------------------------------


def concat(*xs) -> Column:
    return F.concat(*[col(x) for x in xs])


def printf(template: str, *args: Column) -> Column:
    """C-like formatting: arguments are cast by their specifier; a null number counts as 0, a null text as empty.

    ``%q`` doubles single quotes, ``%Q`` also adds them around (NULL for null), ``%w`` doubles double quotes.
    """
    import re

    used, kinds = [], iter(args)

    def replace(m) -> str:
        kind = m.group(2)
        if kind == "%":
            return "%%"
        x = next(kinds, F.lit(None))
        if kind in "di":
            used.append(F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
            return f"%{m.group(1)}d"
        if kind in "feEgG":
            used.append(F.coalesce(x.try_cast("double"), F.lit(0.0)))
            return f"%{m.group(1)}{kind}"
        if kind in "xXo":
            used.append(F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
            return f"%{m.group(1)}{kind}"
        if kind == "c":
            used.append(F.substring(F.coalesce(x.cast("string"), F.lit("")), 1, 1))
            return f"%{m.group(1)}s"
        text = F.coalesce(x.cast("string"), F.lit(""))
        if kind == "q":
            text = F.replace(text, F.lit("'"), F.lit("''"))
        elif kind == "Q":
            text = F.when(x.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")))
        elif kind == "w":
            text = F.replace(text, F.lit('"'), F.lit('""'))
        used.append(text)
        return f"%{m.group(1)}s"

    text = re.sub(r"%([-+ 0#]*[0-9]*(?:\.[0-9]+)?)([%diufeEgGxXoscqQw])", replace, template)
    return F.format_string(text, *used) if used else F.format_string(text)


def _whole_json(x: Column) -> Column:
    """The parser ignores what follows a value; inside brackets and inside braces it cannot."""
    alone = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    inside = F.try_parse_json(F.concat(F.lit('{"a":'), x, F.lit("}"))).isNotNull()
    return F.coalesce(F.try_parse_json(x).isNotNull() & alone & inside, F.lit(False))


def json_valid(x: Column) -> Column:
    return _whole_json(x)


def json_array_length(x: Column, path: str | None = None) -> Column:
    """0 for JSON that is no array; null for a path that leads nowhere and for malformed text."""
    if path is not None:
        x = F.get_json_object(x, path)
        return F.when(x.isNotNull(), F.coalesce(F.json_array_length(x), F.lit(0)).cast("bigint"))
    return F.when(_whole_json(x), F.coalesce(F.json_array_length(x), F.lit(0)).cast("bigint"))


# --- aggregates -----------------------------------------------------------------------------------------------------


def total(x: Column, distinct: bool = False) -> Column:
    """A double, 0.0 without rows."""
    return F.coalesce((F.sum_distinct if distinct else F.sum)(x.cast("double")), F.lit(0.0))


def avg(x: Column, distinct: bool = False) -> Column:
    return F.try_divide(F.sum_distinct(x.cast("double")), F.count_distinct(x)) if distinct else F.avg(x)


def group_concat(x: Column, separator: str = ",", distinct: bool = False) -> Column:
    """Values joined in ascending order, so that the result does not depend on how rows are dealt out; null without values."""
    values = (F.collect_set if distinct else F.collect_list)(x.cast("string"))
    return F.when(F.count(x) > 0, F.array_join(F.array_sort(values), separator))
