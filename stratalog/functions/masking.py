"""Masking a line into a pattern with ordered parameters, and back, in built-in expressions.

A pattern is an escaped-brace string: ``{name}`` is a slot, literal braces are doubled. One regular
expression pass puts every entity between marks, with one group of the expression after the other,
so that the number of empty groups before the text tells its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The entities in their order of priority, and the slot names they get.
ENTITIES = (
    ("ts", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("time", r"\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?"),
    ("date", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("uuid", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("ip", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?"),
    ("path", r"/(?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?:[\w.@*-]+/)*[\w@*-]+(?:\.[\w@*-]+)*"),
    ("hash", r"\b[0-9a-fA-F]{16,}\b"),
    ("size", r"\b\d+(?:\.\d+)?(?:ms|ns|s|KB|MB|GB|B)\b"),
    ("num", r"(?<![A-Za-z0-9])-?\d+(?:\.\d+)?"),
)
SIGN = r"[0-9/]|[a-fA-F]{16}"
ENTITY = "|".join(f"({p})" for _, p in ENTITIES)
EDGE, GROUP, SLOT = "\u0001", "\u0002", "\u0003"
_MARKS = "[\u0001\u0002\u0003]"


def has_marks(line: Column) -> Column:
    """Whether a line holds characters that masking uses as marks; such lines are stored raw."""
    return F.coalesce(line.rlike(_MARKS), F.lit(False))


def masked(df: DataFrame, line: str, pattern: str = "pattern", params: str = "params") -> DataFrame:
    """``df`` with the pattern and parameters of ``line``; a null line gives an empty pattern."""
    text = F.coalesce(F.col(line), F.lit(""))
    groups = GROUP.join(f"${i}" for i in range(1, len(ENTITIES) + 1))
    segments = F.split(F.regexp_replace(text, ENTITY, f"{EDGE}{groups}{EDGE}"), EDGE, -1)
    names = F.array(*(F.lit("{" + name + "}") for name, _ in ENTITIES))
    kind = lambda s: F.length(F.regexp_extract(s, f"^({GROUP}*)", 1)) + 1
    doubled = lambda s: F.replace(F.replace(s, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    # what no entity can be in: without a digit, a path or a long run of hexadecimal letters
    out = df.withColumn("__segments", F.when(text.rlike(SIGN), segments).otherwise(F.array(text)))
    parts = F.transform("__segments", lambda s, i: F.when(i % 2 == 1, F.element_at(names, kind(s))).otherwise(doubled(s)))
    values = F.transform(F.filter("__segments", lambda s, i: i % 2 == 1), lambda s: F.translate(s, GROUP, ""))
    return out.withColumns({pattern: F.array_join(parts, ""), params: values}).drop("__segments")


def _cut(pattern: Column) -> Column:
    """A pattern as literal, slot name, literal, ..., literal, by one scan from the left."""
    found = F.split(F.regexp_replace(pattern, r"(\{\{)|(\}\})|\{([^}]*)\}", f"{EDGE}$1{GROUP}$2{GROUP}$3{EDGE}"), EDGE, -1)

    def part(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, s).when(F.startswith(s, F.lit("{{")), "{").when(F.startswith(s, F.lit(GROUP + "}}")), "}").otherwise(F.concat(F.lit(SLOT), F.substring(s, 3, 1 << 20), F.lit(SLOT)))

    cut = F.split(F.array_join(F.transform(found, part), ""), SLOT, -1)
    return F.when(pattern.rlike("[{}]"), cut).otherwise(F.when(pattern.isNotNull(), F.array(pattern)))


def literals(pattern: Column) -> Column:
    """The text between the slots, one more than there are slots."""
    return F.filter(_cut(pattern), lambda s, i: i % 2 == 0)


def slots(pattern: Column) -> Column:
    """The names of a pattern's slots as they stand."""
    return F.filter(_cut(pattern), lambda s, i: i % 2 == 1)


def slot_count(pattern: Column) -> Column:
    return F.size(slots(pattern))


def slot_names(own_slots: Column) -> Column:
    """Slot names made unique: the second ``num`` is ``num_1``, and so on."""

    def name(s: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(own_slots, F.lit(1), i), lambda x: x == s))
        return F.when(before == 0, s).otherwise(F.concat_ws("_", s, before.cast("string")))

    return F.transform(own_slots, name)


def slot_base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)_\d+$", "$1")


def strip_key_prefix(value: Column, slot: Column) -> Column:
    """``key=value`` to ``value`` where the key is the slot's base name."""
    at = F.instr(value, "=")
    return F.when((at > 1) & (F.left(value, at - 1) == slot_base_name(slot)), F.substr(value, at + 1)).otherwise(value)


def param_map(own_slots: Column, params: Column) -> Column:
    """Unique slot names to values, as far as there are both."""
    n = F.least(F.size(own_slots), F.size(params))
    return F.map_from_arrays(F.slice(slot_names(own_slots), F.lit(1), n), F.slice(params, F.lit(1), n))


def fill(own_literals: Column, params: Column) -> Column:
    """The line of a pattern's literals and the parameters; surplus parameters are ignored, too few
    give null."""
    n = F.size(own_literals) - 1
    line = F.array_join(F.zip_with(own_literals, F.slice(params, F.lit(1), n), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(params) >= n, line)


def unmask(pattern: Column, params: Column) -> Column:
    return fill(literals(pattern), params)


def unmask_named(pattern: Column, values: Column) -> Column:
    """The line of a pattern and a map from unique slot names to values; a repeated name that is
    missing falls back to its base name in braces, and a missing one gives null."""
    names = slot_names(slots(pattern))
    found = F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.try_element_at(values, F.concat(F.lit("{"), slot_base_name(n), F.lit("}")))))
    return F.when(~F.exists(found, lambda v: v.isNull()), unmask(pattern, found))


def with_continuation(header: Column, continuation: Column) -> Column:
    return F.concat_ws("\n", header, F.when(continuation != "", continuation))


def pattern_query(pattern: Column | str) -> Column:
    """The slot names that people write for numbers, read as ``{num}``."""
    out = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_replace(out, r"\{(?:id|x|count)(_\d+)?\}", "{num$1}")


def similarity(a: Column, b: Column) -> Column:
    """The share of equal tokens at equal places, of the longer of two token lists."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.try_divide(same.cast("double"), F.greatest(F.size(a), F.size(b)).cast("double"))


def digest(line: Column) -> Column:
    return F.sha2(line, 256)
