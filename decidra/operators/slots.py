"""Typed arguments from free text, and the compilation of tool calls. Native expressions only."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.functions.scores import bound

TYPES = ("string", "enum", "boolean", "integer", "number", "date", "datetime", "email", "url", "phone", "id", "object", "array")
# The shape of each type, and the formats of dates in the order they are tried.
NUMBER = r"[-+]?\d{1,3}(?:[ ,]\d{3})*(?:\.\d+)?|[-+]?\d+(?:\.\d+)?"
NUMBER_ANY_LENGTH = r"[-+]?(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.\d+)?"
SHAPES = {
    "email": r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+",
    "url": r"(?i)(?:https?://|www\.)[^\s,;]+",
    "phone": r"(?:\+\d{1,3}[\s-]?)?(?:\(\d{2,4}\)[\s-]?)?\d{3}[\s-]?\d{3,4}(?:[\s-]?\d{2,4})?",
    "id": r"\b[A-Za-z]{0,4}[-_]?\d{3,}\b",
    "date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    "datetime": r"\b\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(?::\d{2})?\b",
    "integer": r"\b[-+]?\d[\d,]*(?=\s|$|[.,;)])",
    "number": r"\b[-+]?\d[\d,]*(?:\.\d+)?(?=\s|$|[.,;)])",
    "boolean": r"(?i)\b(?:true|false|yes|no|y|n)\b",
}
QUANTITY = r"([-+]?\$?\d[\d,\.]*\s*(?:%|percent|km|miles|m|kg|lbs)?)"
DATE_FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d/M/yy", "M/d/yy")
_DATE_SHAPES = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$", r"^\d{1,2}/\d{1,2}/\d{2}$")
TRUE, FALSE = ["true", "yes", "y", "1", "on"], ["false", "no", "n", "0", "off"]


@dataclass(frozen=True)
class Arg:
    """A declared argument; an unknown type, an enum without values, an object without fields or an array without an item type is an error."""

    name: str
    type: str
    required: bool = False
    enum: tuple[str, ...] = ()
    fields: tuple["Arg", ...] = ()
    item_type: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.type}")
        if self.type == "enum" and not self.enum or self.type == "object" and not self.fields or self.type == "array" and not self.item_type:
            raise ValueError(f"{self.name}: {self.type} needs its values, fields or item type")


@dataclass(frozen=True)
class Tool:
    tool_id: str
    name: str
    description: str = ""
    family: str = ""
    args: tuple[Arg, ...] = field(default_factory=tuple)

    def required_paths(self) -> list[str]:
        """Required arguments, and of every object, required or not, its required fields as ``arg.field``."""
        return [p for a in self.args for p in ([f"{a.name}.{f.name}" for f in a.fields if f.required] if a.type == "object" else [a.name] * a.required)]

    def card_text(self) -> str:
        """The one text that stands for the tool wherever texts are compared."""
        kinds = [f"{a.name}: " + (f"enum({','.join(a.enum)})" if a.enum else a.type) for a in self.args]
        needed = ", ".join(a.name for a in self.args if a.required) or "none"
        return "; ".join(filter(None, (self.name.replace("_", " "), self.description.strip(), *([f"required: {needed}", *kinds] if self.args else []))))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Tool":
        """The inverse of ``to_json``; arguments are required unless they say otherwise."""

        def arg(d: dict, required: bool) -> Arg:
            fields = tuple(arg(f, required) for f in d.get("fields") or ())
            return Arg(d["name"], d["type"], bool(d.get("required", required)), tuple(d.get("enum") or ()), fields, d.get("item_type") or None, d.get("description") or "")

        d = json.loads(text)
        return Tool(d["tool_id"], d["name"], d.get("description") or "", d.get("family") or "", tuple(arg(a, True) for a in d.get("args") or ()))


def catalog(spark: SparkSession, tools: list[Tool]) -> DataFrame:
    """(tool_id, name, family, card, definition): a catalog as a table, which ``tools_of`` reads back."""
    return spark.createDataFrame([(t.tool_id, t.name, t.family, t.card_text(), t.to_json()) for t in tools], "tool_id string, name string, family string, card string, definition string")


def tools_of(table: DataFrame) -> list[Tool]:
    """The tools of a catalog, by id; a catalog is a bounded list of definitions, no data."""
    return [Tool.from_json(r["definition"]) for r in table.select("tool_id", "definition").orderBy("tool_id").collect()]


def iso_date(raw: Column) -> Column:
    """ISO form of a date, formats tried in order, day before month; two-digit years from 69 on are of the last century."""
    tries = []
    for fmt, shape in zip(DATE_FORMATS, _DATE_SHAPES):
        parsed = F.to_date(F.try_to_timestamp(F.when(raw.rlike(shape), raw), F.lit(fmt)))
        if fmt.endswith("yy") and not fmt.endswith("yyyy"):
            parsed = F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)
        tries.append(parsed)
    return F.date_format(F.coalesce(*tries), "yyyy-MM-dd")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def coerce(raw: Column, arg: Arg, compat: bool = True) -> Column:
    """The value of a raw text as its type, written as a string; null if it is no instance of the type.

    With ``compat`` numbers of four digits or more without separators are cut after three, as in the published behavior.
    """
    s = F.trim(raw)
    low = F.lower(s)
    number = F.regexp_replace(_first(s, NUMBER if compat else NUMBER_ANY_LENGTH), "[ ,]", "").try_cast("double")
    if arg.type == "boolean":
        return F.when(low.isin(*TRUE), "true").when(low.isin(*FALSE), "false")
    if arg.type == "integer":
        return F.when(number == F.floor(number), number.cast("long").cast("string"))
    if arg.type == "number":
        return number.cast("string")
    if arg.type == "date":
        return iso_date(_first(s, SHAPES["date"]))
    if arg.type == "datetime":
        found = r"\b(\d{4}-\d{2}-\d{2})[T ](\d{1,2}):(\d{2})(?::(\d{2}))?\b"
        day, h, m, sec = iso_date(_first(s, found, 1)), *(F.coalesce(_first(s, found, k).try_cast("int"), F.lit(0)) for k in (2, 3, 4))
        return F.when(day.isNotNull() & (h <= 23) & (m <= 59) & (sec <= 59), F.format_string("%sT%02d:%02d:%02d", day, h, m, sec))
    if arg.type == "url":
        v = F.rtrim(_first(s, SHAPES["url"]), F.lit(".,;)"))
        return F.when(F.lower(v).startswith("http"), v).otherwise(F.concat(F.lit("https://"), v))
    if arg.type in ("email", "phone", "id"):
        return F.trim(_first(s, SHAPES[arg.type]))
    if arg.type == "enum":
        return F.coalesce(*(F.when(low == e.strip().lower(), F.lit(e)) for e in arg.enum))
    return F.when(s != "", s)


_FOUND = "array<struct<value:string,raw:string>>"


def _labels(arg: Arg) -> list[str]:
    """Patterns of a value behind (quantities: also before) the argument's name, from the shape of its type."""
    name = re.escape(arg.name.replace("_", " ").strip())
    label = rf"(?:the\s+)?{name}\s*(?:is|=|:)?\s*"
    if arg.type in ("integer", "number"):
        return [label + QUANTITY, rf"{QUANTITY}\s*(?:of\s+)?(?:for\s+)?{name}"]
    return [f"{label}({SHAPES[arg.type].removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')})"] if arg.type in ("date", "datetime") else []


def extract_slot(state: Column, arg: Arg, compat: bool = True) -> Column:
    """``struct<state,value,candidates,start,end,reason>``: VALUE, MISSING or AMBIGUOUS.

    A value behind the argument's name wins if it is unique; otherwise all texts of the type's shape are candidates. Null
    states are MISSING, as are types without a shape (string, object, array). ``start`` and ``end`` are the half-open
    range, from 0, of the first spelling of a VALUE in the state.
    """
    text = F.coalesce(state, F.lit(""))
    none = F.expr(f"cast(array() as {_FOUND})")
    pair = lambda value, raw: F.struct(value.alias("value"), raw.alias("raw"))

    def valid(found: Column) -> Column:
        every = F.filter(F.transform(found, lambda v: pair(coerce(v, arg, compat), v)), lambda x: x["value"].isNotNull())
        first = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, 1, i), lambda y: y["value"] == x["value"]))
        return bound(every, first)

    if arg.type == "enum":
        hits = [F.regexp_extract(text, rf"(?iU)\b{re.escape(e)}\b", 0) for e in arg.enum if "_" in e or re.fullmatch(r"\w+", e)]
        own = [e for e in arg.enum if "_" in e or re.fullmatch(r"\w+", e)]
        values = F.array_compact(F.array(*(F.when(h != "", pair(F.lit(e), h)) for e, h in zip(own, hits)))) if own else none
        labeled = none
    else:
        said = [_first(text, "(?i)" + p, 1) for p in _labels(arg)]
        labeled = valid(F.array(*said)) if said else none
        values = valid(F.regexp_extract_all(text, F.lit(SHAPES[arg.type]), F.lit(0))) if arg.type in SHAPES else none
    chosen = F.when(F.size(labeled) == 1, labeled).otherwise(values)

    def decision(c: Column) -> Column:
        n, start = F.size(c), F.instr(text, F.get(c, F.lit(0))["raw"]) - 1
        kind = F.when(n == 0, "MISSING").when(n == 1, "VALUE").otherwise("AMBIGUOUS")
        reason = F.when(n == 0, f"no {arg.type} value found for {arg.name}").when(n == 1, f"{arg.type} exact match").otherwise(F.concat(n.cast("string"), F.lit(f" incompatible {arg.type} candidates")))
        several = F.when(n > 1, F.transform(c, lambda x: x["value"])).otherwise(F.expr("cast(array() as array<string>)"))
        one = lambda x: F.when(n == 1, x)
        return F.struct(kind.alias("state"), one(F.get(c, F.lit(0))["value"]).alias("value"), several.alias("candidates"), one(start).alias("start"), one(start + F.length(F.get(c, F.lit(0))["raw"])).alias("end"), reason.alias("reason"))

    return bound(chosen, decision)


def coerce_items(items: Column, item_type: str, compat: bool = True) -> Column:
    """``struct<items,invalid>``: the valid items of an array of raw texts as their type, and how many are none."""
    own = F.filter(F.transform(items, lambda v: coerce(v, Arg("item", item_type), compat)), lambda v: v.isNotNull())
    return bound(own, lambda v: F.struct(v.alias("items"), (F.size(items) - F.size(v)).alias("invalid")))


def extract_all(df: DataFrame, state: str, tool: Tool, compat: bool = True) -> DataFrame:
    """Adds ``slots``: map of argument to its decision, nested fields as ``arg.field``."""
    flat = [(a.name, a) for a in tool.args if a.type != "object"] + [(f"{a.name}.{f.name}", f) for a in tool.args if a.type == "object" for f in a.fields]
    return df.withColumn("slots", F.create_map(*[x for n, a in flat for x in (F.lit(n), extract_slot(F.col(state), a, compat))]))


def compile_call(df: DataFrame, tool: Tool, slots: str = "slots", extra: Column | None = None) -> DataFrame:
    """Adds ``call``: struct<outcome, args map, missing, ambiguous, unsupported, reasons, evidence>.

    REJECT if ``extra`` names undeclared arguments, else ASK_FOR_INFO if a required one is missing or ambiguous, else ACT.
    Optional arguments that do not resolve are left out. An object of which no field has a value is missing as a whole, if
    it is required; of one that has some, its required fields. ``evidence`` has the range of each value.
    """
    s = F.col(slots)
    state = lambda n: F.coalesce(s[n]["state"], F.lit("MISSING"))
    wanted: list[tuple[str, Column]] = []  # path, whether it is asked for
    for a in tool.args:
        if a.type != "object":
            wanted += [(a.name, F.lit(True))] if a.required else []
            continue
        paths = [f"{a.name}.{f.name}" for f in a.fields]
        some = F.greatest(*(state(p) == "VALUE" for p in paths), F.lit(False))
        wanted += [(a.name, ~some)] if a.required else []
        wanted += [(f"{a.name}.{f.name}", some) for f in a.fields if f.required]
    kind_of = lambda n: state(n) if any(n == x.name and x.type != "object" for x in tool.args) or "." in n else F.lit("MISSING")
    texts = lambda xs: F.array_compact(F.array(*xs, F.lit(None).cast("string")))
    pick = lambda kind: texts(F.when(asked & (kind_of(n) == kind), F.lit(n)) for n, asked in wanted)
    missing, ambiguous = pick("MISSING"), pick("AMBIGUOUS")
    declared = F.array(*(F.lit(a.name) for a in tool.args)) if tool.args else F.expr("cast(array() as array<string>)")
    unsupported = F.array_sort(F.array_except(extra, declared)) if extra is not None else F.expr("cast(array() as array<string>)")
    args = F.map_filter(F.transform_values(s, lambda k, v: v["value"]), lambda k, v: v.isNotNull())
    reasons = F.concat(
        F.transform(missing, lambda n: F.concat(F.lit("required arg "), n, F.lit(" unresolved"))), F.transform(ambiguous, lambda n: F.concat(F.lit("required arg "), n, F.lit(" ambiguous"))),
        F.transform(unsupported, lambda n: F.concat(F.lit("unsupported arg "), n)),
    )
    evidence = F.transform(F.filter(F.map_entries(s), lambda e: e["value"]["start"].isNotNull()), lambda e: F.struct(e["key"].alias("arg"), e["value"]["start"].alias("start"), e["value"]["end"].alias("end")))
    outcome = F.when(F.size(unsupported) > 0, "REJECT").when(F.size(missing) + F.size(ambiguous) > 0, "ASK_FOR_INFO").otherwise("ACT")
    return df.withColumn("call", F.struct(outcome.alias("outcome"), args.alias("args"), missing.alias("missing"), ambiguous.alias("ambiguous"), unsupported.alias("unsupported"), reasons.alias("reasons"), evidence.alias("evidence")))


def schema_errors(args: Column, tool: Tool) -> Column:
    """Array of errors of finished arguments (a map of texts; objects and arrays as JSON): undeclared, missing, of the wrong type."""
    none = F.expr("cast(array() as array<string>)")
    names = lambda xs: F.array(*(F.lit(x.name) for x in xs)) if xs else none

    def of(values: Column, declared: tuple[Arg, ...], prefix: str) -> Column:
        found = F.transform(F.array_except(F.map_keys(values), names(declared)), lambda k: F.concat(F.lit(f"unsupported arg {prefix}"), k))
        checks, nested = [], []
        for a in declared:
            path, here = f"{prefix}{a.name}", F.map_contains_key(values, a.name)
            if a.required:
                checks.append(F.when(~here, F.lit(f"missing required arg {path}")))
            if a.type == "object":
                inner = F.from_json(values[a.name], "map<string,string>")
                checks.append(F.when(here & inner.isNull(), F.lit(f"arg {path} must be object")))
                nested.append(F.when(here & inner.isNotNull(), of(inner, a.fields, f"{path}.")).otherwise(none))
            elif a.type == "array":
                items = F.from_json(values[a.name], "array<string>")
                checks.append(F.when(here & (items.isNull() | ~F.startswith(F.ltrim(values[a.name]), F.lit("["))), F.lit(f"arg {path} must be array")))
                checks.append(F.when(here & F.exists(items, lambda v: coerce(v, Arg("item", a.item_type or "string")).isNull()), F.lit(f"array {path} has an invalid item")))
            else:
                checks.append(F.when(here & coerce(values[a.name], a).isNull(), F.lit(f"arg {path} invalid {a.type}")))
        return F.concat(found, F.array_compact(F.array(*checks, F.lit(None).cast("string"))), *nested)

    return of(args, tool.args, "")
