"""Facts stated in candidate texts, as columns: no Python runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fact with its unit, and the identity in front of a text.
FACT = r"(?iU)([a-z][a-z _-]*?)\s*[:=]?\s*(-?[0-9]*\.?[0-9]+)\s*(ms|s|k|m|%)?\b"
IDENTITY = r"(?iU)^\s*(option\s+)?[\w-]+\s*[:\-]\s*"
# Phrases that assert or deny a concept.
ASSERTED = {"permitted": ["permitted", "allowed", "legal"], "tool_support": ["supports tools", "tool support", "tool-capable", "supports the required tools"]}
DENIED = {"permitted": ["not permitted", "disallowed", "prohibited", "illegal"], "tool_support": ["no tool", "not support", "no tools", "tools unsupported", "not tool"]}


def strip_identity(text: Column) -> Column:
    """The text without a leading "Option B:" or "route_a -"; a leading "key:" goes as well."""
    return F.trim(F.regexp_replace(text, F.lit(IDENTITY), F.lit("")), F.lit(" \t\r\n"))


#: A fact, or a run of letters that leads to no number: such a run is passed over as a whole, so a text is read once.
_ONE_PASS = FACT + r"|[a-z][a-z _-]*+"
_BEGIN, _NUMBER, _UNIT, _END = "\u0001", "\u0002", "\u0003", "\u0004"


def facts(text: Column) -> Column:
    """``array<struct<key,value>>`` of the facts of a text in reading order; k and m scale by a thousand and a million.

    One pass writes key, number and unit of each fact between marks (control characters of the text itself are taken out
    before), which are then cut apart.
    """
    clean = F.translate(text, _BEGIN + _NUMBER + _UNIT + _END, "    ")
    marked = F.regexp_replace(clean, F.lit(_ONE_PASS), F.lit(f"{_BEGIN}$1{_NUMBER}$2{_UNIT}$3{_END}"))

    def fact(piece: Column) -> Column:
        head = F.substring_index(piece, _END, 1)
        unit = F.lower(F.substring_index(head, _UNIT, -1))
        front = F.substring_index(head, _UNIT, 1)
        scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
        key = F.trim(F.replace(F.lower(F.trim(F.substring_index(front, _NUMBER, 1))), F.lit(" "), F.lit("_")), F.lit("_"))
        return F.struct(key.alias("key"), (F.substring_index(front, _NUMBER, -1).try_cast("double") * scale).alias("value"))

    found = F.filter(F.split(marked, _BEGIN), lambda x: F.contains(x, F.lit(_UNIT)) & ~F.startswith(x, F.lit(_NUMBER)))
    return F.filter(F.transform(found, fact), lambda f: f["key"] != "")


def fact(found: Column, key: Column | str) -> Column:
    """The value of a key, null if it is not stated; the last statement holds."""
    wanted = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.filter(found, lambda f: f["key"] == wanted), F.lit(-1))["value"]


def axis_key(axis: str) -> str:
    return axis.strip().lower().replace(" ", "_")


def concept_value(text: Column, concept: str) -> Column:
    """1 if the text asserts the concept, -1 if it denies it or is silent; denial goes first."""
    low = F.lower(text)
    denied = [F.contains(low, F.lit(p)) for p in DENIED.get(concept, [f"not {concept}", f"no {concept}"])]
    asserted = [F.contains(low, F.lit(p)) for p in ASSERTED.get(concept, [concept])]
    either = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
    return F.when(either(denied), -1.0).when(either(asserted), 1.0).otherwise(-1.0)
