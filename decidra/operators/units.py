"""Quantities recorded in different units: extraction from free wording, exact conversion, and unit choice by identities.

``measurements`` reads the quantities a text states. A unit in the text holds for its quantity, otherwise the unit its
source declares. Where neither is known, ``resolve_units`` chooses the combination of units under which physical
identities among columns (mass = density x volume) hold best, and flags solutions that are not unique.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decidra.session import bounded_broadcast, unique_name

# The names of each quantity in the languages of the catalogs.
NAMES = {
    "latency": "latency|p50 latency|round trip|response time|Latenz|Antwortzeit|latence|temps de réponse|latencia|tiempo de respuesta|延迟|响应时间|遅延|応答時間",
    "price": "list price|price|cost per use|cost|Preis|Kosten|prix|coût|precio|coste|价格|费用|価格|料金",
    "context": "context window|context|window|Kontextfenster|Kontext|fenêtre de contexte|contexte|ventana de contexto|contexto|上下文窗口|上下文|コンテキスト長|コンテキスト",
    "memory": "memory footprint|memory|RAM|resident size|Speicherbedarf|Speicher|mémoire|memoria|内存|メモリ",
    "quality": "quality score|quality|accuracy|Güte|Qualität|qualité|calidad|质量|品質",
    "throughput": "throughput|speed|rate|Durchsatz|débit|rendimiento|caudal|吞吐量|スループット",
    "energy": "energy per call|energy|power use|Energiebedarf|Energie|énergie|energía|能耗|消費電力量",
}
_TOK = r"(?:[Tt]okens?|tok|[Jj]etons?|トークン)"
_THOUSAND, _MILLION = r"(?:k|1k|1[.,\u00a0 ]?000|thousand|Tsd\.|mille|mil|千)", r"(?:M|1M|1 ?Mio\.|Mio\.|millions?(?: de)?|mill[oó]n(?:es)? de|1 million|百万|100万)"
_PER = r"(?: ?/ ?| per | pro | je | par | por | par | a )"
_CENT, _DOLLAR = r"(?:¢|cents?|ct)", r"(?:USD|US\$|\$|dollars?|美元|ドル)"
# Spellings of units with their size in the quantity's base unit, as numerator and denominator; the first that matches holds.
UNITS: dict[str, list[tuple[str, int, int]]] = {
    "latency": [
        (r"(?:us|µs|μs|micros|microseconds?|Mikrosekunden?|microsecondes?|microsegundos?|微秒|マイクロ秒)", 1, 1),
        (r"(?:ms|millis|msecs?|milliseconds?|Millisekunden?|millisecondes?|milisegundos?|毫秒|ミリ秒)", 1000, 1),
        (r"(?:minutes?|mins?|Minuten?|minutos?|分钟|分)", 60_000_000, 1),
        (r"(?:seconds?|secs?|Sekunden?|Sek|secondes?|segundos?|s|秒)", 1_000_000, 1),
    ],
    "price": [
        (rf"{_CENT}{_PER}(?:{_MILLION} ?{_TOK}?|Mtok)", 10, 1),
        (rf"{_CENT}{_PER}(?:{_THOUSAND} ?{_TOK}?|ktok)", 10_000, 1),
        (rf"{_DOLLAR}{_PER}(?:{_MILLION} ?{_TOK}?|Mtok)", 1000, 1),
        (rf"{_DOLLAR}{_PER}(?:{_THOUSAND} ?{_TOK}?|ktok)", 1_000_000, 1),
    ],
    "context": [
        (rf"(?:M|million|millions|Mio\.)(?: (?:de )?{_TOK})?", 1_000_000, 1),
        (rf"mill[oó]n(?:es)? de {_TOK}", 1_000_000, 1),
        (rf"millions? de {_TOK}", 1_000_000, 1),
        (rf"万 ?{_TOK}?", 10_000, 1),
        (rf"(?:k|thousand|Tsd\.|mille|mil|千)(?: ?{_TOK})?", 1000, 1),
        (_TOK, 1, 1),
    ],
    "memory": [
        (r"(?:GiB|gibibytes?|Gio)", 1024**3, 1),
        (r"(?:MiB|mebibytes?|Mio)", 1024**2, 1),
        (r"(?:KiB|kibibytes?|Kio)", 1024, 1),
        (r"(?:TB|terabytes?)", 10**12, 1),
        (r"(?:GB|gigabytes?|Go|千兆字节)", 10**9, 1),
        (r"(?:MB|megabytes?|Mo|兆字节)", 10**6, 1),
        (r"(?:KB|kilobytes?|ko)", 1000, 1),
    ],
    "quality": [
        (r"(?:%|percent|per cent|pct|Prozent|pour cent|por ciento|パーセント|百分点)", 100, 1),
        (r"(?:‰|per mille|per mil|Promille|pour mille|por mil|パーミル)", 10, 1),
        (r"(?:/ ?10|out of (?:10|ten)|von (?:10|zehn)|sur (?:10|dix)|sobre (?:10|diez)|of ten)", 1000, 1),
        (r"fraction", 10_000, 1),
    ],
    "throughput": [
        (rf"(?:k ?|thousand |mil |mille |Tsd\. ){_TOK}{_PER}(?:s|sec|second|Sekunde|seconde|segundo|秒)", 3_600_000, 1),
        (rf"(?:k ?|thousand |mil |mille |Tsd\. ){_TOK}{_PER}(?:minute|min|Minute|minuto|分)", 60_000, 1),
        (rf"(?:k ?|thousand |mil |mille |Tsd\. ){_TOK}{_PER}(?:hour|h|Stunde|heure|hora|小时|時間)", 1000, 1),
        (rf"(?:{_TOK}{_PER}(?:seconds?|sec|s|Sekunde|seconde|segundo|秒)|tps)", 3600, 1),
        (rf"(?:{_TOK}{_PER}(?:minutes?|min|Minute|minuto|分)|tpm)", 60, 1),
        (rf"{_TOK}{_PER}(?:hours?|h|Stunde|heure|hora|小时|時間)", 1, 1),
    ],
    "energy": [
        (r"(?:kWh|kilowatt-hours?)", 3_600_000_000, 1),
        (r"(?:mWh|milliwatt-hours?)", 3600, 1),
        (r"(?:Wh|watt-hours?|watt hours?|Wattstunden?|wattheures?)", 3_600_000, 1),
        (r"(?:kJ|kilojoules?)", 1_000_000, 1),
        (r"(?:mJ|millijoules?)", 1, 1),
        (r"(?:joules?|J)", 1000, 1),
    ],
}
# Durations in words, in microseconds.
_WORDS = {
    250_000: "a quarter of a second|quarter of a second|eine Viertelsekunde|un quart de seconde|un cuarto de segundo|四分之一秒|四分の一秒",
    500_000: "half a second|eine halbe Sekunde|une demi-seconde|medio segundo|半秒|0\\.5秒",
    1_500_000: "one and a half seconds|a second and a half|anderthalb Sekunden|eineinhalb Sekunden|une seconde et demie|un segundo y medio|一秒半",
    1_000_000: "one second|a second|eine Sekunde|une seconde|un segundo|一秒",
    2_000_000: "two seconds|zwei Sekunden|deux secondes|dos segundos|两秒|二秒",
    3_000_000: "three seconds|drei Sekunden|trois secondes|tres segundos|三秒",
    100_000: "a hundred milliseconds|one hundred milliseconds|hundert Millisekunden|cent millisecondes|cien milisegundos|一百毫秒|百ミリ秒",
    30_000_000: "half a minute|eine halbe Minute|une demi-minute|medio minuto|半分钟|三十秒",
    60_000_000: "one minute|a minute|eine Minute|une minute|un minuto|一分钟|一分",
    120_000_000: "two minutes|zwei Minuten|deux minutes|dos minutos|两分钟|二分",
    200_000: "two hundred milliseconds|zweihundert Millisekunden|deux cents millisecondes|doscientos milisegundos|两百毫秒|二百ミリ秒",
}
_BY_NAME = {v: q for q, names in NAMES.items() for n in names.split("|") for v in (n, n[0].upper() + n[1:], n.upper())}


def _by_first(names: list[str]) -> str:
    """An alternation, the longest first, that branches on the first letter only once."""
    firsts = sorted({n[0] for n in names})
    return "|".join(f"{f}(?:{'|'.join(n[1:] for n in sorted(names, key=lambda n: (-len(n), n)) if n[0] == f)})" for f in firsts)


_NAME = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:{_by_first(list(_BY_NAME))})(?![a-zà-ÿ])")
_FILL = re.compile(r"[    ]*[)）]?[    ]*(?:stays at|is about|is|of|at|liegt bei|beträgt|est de|es de|为|は)?[    ]*[:=：]?[    ]*(?:ca\.|env\.|aprox\.|approx\.|about|约|約)?[    ]*")
_NUMBER = re.compile(r"\d{1,3}(?:[    ]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,_'’]\d+)*|[.,]\d+")
_SPACES, _NO_UNIT = frozenset(" \u00a0\u202f\u2009"), frozenset(["", *" .,;:|!?)）。，；、"])
_END = r"(?![A-Za-zÀ-ÿµμ])"
# The letters and marks that spellings of units begin with.
_BEGINS = {"latency": "uµμmsåé微毫マミ分秒", "price": "¢cu$d美ド", "context": "tjトm万k千", "memory": "gmktb兆千", "quality": "%p‰/ovsf百パ", "throughput": "ktjmトt", "energy": "kmwj"}
_SCALES = {q: [(n, d) for _, n, d in units] for q, units in UNITS.items()}
_UNIT, _UNIT_ANY = ({q: re.compile("|".join(f"({p}){_END}" for p, _, _ in units), flags) for q, units in UNITS.items()} for flags in (0, re.I))
_SECONDS = re.compile(r"[ \u00a0\u202f]?(\d+(?:[.,]\d+)?)[ \u00a0\u202f]?(?:seconds?|secs?|Sekunden?|Sek|secondes?|segundos?|s|秒)" + _END)
_WORD = re.compile("|".join(f"(?P<w{v}>{p})" for v, p in sorted(_WORDS.items(), key=lambda x: -max(map(len, x[1].split("|"))))), re.I)


_SENTENCE_END = re.compile(r"[.!?]\s|[。！？]|\n")
#: Values beyond this are no measurements: they become null.
LARGEST = 2**63 - 1
_GROUPING = str.maketrans("", "", "_'’ \u00a0\u202f\u2009")
_HEADER_END, _HEADER_VALUE = re.compile(r" ?[,;:、：)）]|\.[,;:)]|$"), re.compile(r"[:：] ?[\d.,$]")


def parse_number(text: str, mark: str) -> tuple[int, int] | None:
    """(mantissa, decimals) of a number written with the decimal mark ``mark``; None if it can't be read."""
    s = text.translate(_GROUPING)
    if s.isdigit():
        return int(s), 0
    other = "," if mark == "." else "."
    if other in s:
        parts = s.split(mark)[0].split(other)
        grouped = len(parts[0]) <= 3 and parts[0] not in ("", "0") and all(len(p) == 3 for p in parts[1:]) and (s.count(mark) == 0 or s.rfind(other) < s.find(mark))
        if grouped:
            s = s.replace(other, "")
        elif s.count(other) == 1 and mark not in s:
            s, mark = s.replace(other, "."), "."
        else:
            return None
    if s.count(mark) > 1:
        s = s.replace(mark, "")
    whole, _, part = s.partition(mark)
    return int((whole + part) or "0"), len(part)


def _unit_at(text: str, quantity: str, at: int) -> tuple[int, int, int] | None:
    """(numerator, denominator, end) of the unit that begins at a position, or behind one space there."""
    if text[at : at + 1] in _SPACES:
        at += 1
    if text[at : at + 1] in _NO_UNIT:
        return None
    m = _UNIT[quantity].match(text, at)
    if m is None and text[at].lower() in _BEGINS[quantity]:
        m = _UNIT_ANY[quantity].match(text, at)
    return (*_SCALES[quantity][m.lastindex - 1], m.end()) if m else None


@lru_cache(maxsize=4096)
def _declared(units: str) -> dict[str, tuple[int, int]]:
    """The units a source declares: ``quantity=unit`` lines."""
    found = {}
    for line in units.split("\n"):
        quantity, _, unit = line.partition("=")
        if quantity in UNITS and (m := _unit_at(unit, quantity, 0)):
            found[quantity] = m[:2]
    return found


def _value_before(text: str, quantity: str, name: int, after: int) -> int | None:
    """Where the value of a name is that stands before it in its sentence ("With 90 ms, its latency ..."), if it does.

    The number behind "With" is the value if a unit of the quantity follows it, or if none stands behind the name.
    """
    if not text.endswith("its ", 0, name):
        return None
    begin = text.rfind("With ", 0, name) + 5
    if begin < 5 or _SENTENCE_END.search(text, begin, name):
        return None
    number = _NUMBER.match(text, begin + (text[begin : begin + 1] == "$"))
    if number is None:
        return begin if quantity == "latency" and _WORD.match(text, begin) else None
    if text[begin] == "$" or _unit_at(text, quantity, number.end()):
        return begin
    return None if _NUMBER.match(text, _FILL.match(text, after).end()) else begin


def read_measurements(text: str, mark: str, declared: str = "") -> list[tuple[str, int | None, bool]]:
    """(quantity, value in base units or None without a known unit, unit from the text) of each statement."""
    values: list[tuple[str, tuple[int, int], tuple[int, int] | None]] = []
    stated: dict[str, tuple[int, int]] = {}
    for m in _NAME.finditer(text):
        quantity, at, start = _BY_NAME[m[0]], m.end(), None
        if (before := _value_before(text, quantity, m.start(), at)) is not None:
            at = start = before
        dollar = text[at : at + 1] == "$"
        if start is None:
            begins = text[at : at + 1] in (" ", "\u00a0") and not text[at + 1 : at + 2].isdigit()
            header = _unit_at(text, quantity, at) if begins else None
            if header and _HEADER_END.match(text, header[2]) and not _HEADER_VALUE.match(text, header[2]):
                stated.setdefault(quantity, header[:2])
                continue
            gap = text[at : at + 3]
            if gap[1:2].isdigit() and gap[0] in " =":
                at += 1
            elif gap[2:].isdigit() and gap[:2] == ": ":
                at += 2
            else:
                at = _FILL.match(text, at).end()
            dollar = text[at : at + 1] == "$"
        at += dollar
        number = _NUMBER.match(text, at)
        if not number:
            if quantity == "latency" and (word := _WORD.match(text, at)):
                values.append((quantity, (int(word.lastgroup[1:]), 0), (1, 1)))
            continue
        value = parse_number(number[0], mark)
        if value is None:
            continue
        if dollar:
            unit = _unit_at("$" + text[number.end() : number.end() + 40], quantity, 0) if quantity == "price" else None
        else:
            unit = _unit_at(text, quantity, number.end())
        if unit and quantity == "latency" and unit[0] == 60_000_000 and (rest := _SECONDS.match(text, unit[2])) and (more := parse_number(rest[1], mark)):
            whole = value[0] * 60 * 10 ** more[1] + more[0] * 10 ** value[1]  # minutes and seconds
            value, unit = (whole, value[1] + more[1]), (1_000_000, 1, rest.end())
        values.append((quantity, value, unit[:2] if unit else None))
        if unit:
            stated.setdefault(quantity, unit[:2])
    out, known = [], _declared(declared) if declared else {}
    for quantity, (mantissa, decimals), unit in values:
        from_text = unit or stated.get(quantity)
        scale = from_text or known.get(quantity)
        if scale is None:
            out.append((quantity, None, False))
        else:
            top, bottom = mantissa * scale[0], 10**decimals * scale[1]
            value = (2 * top + bottom) // (2 * bottom)
            out.append((quantity, value if value <= LARGEST else None, from_text is not None))
    return out


MEASUREMENTS = T.ArrayType(T.StructType([T.StructField("quantity", T.StringType()), T.StructField("base_value", T.LongType()), T.StructField("unit_in_text", T.BooleanType())]))
_DIGITS_OR_WORDS = re.compile(r"\d|minut|分|second|sekunde|segundo|秒|hundred|hundert|cent |cien ", re.I)


@F.arrow_udf(MEASUREMENTS)  # type: ignore[attr-defined]
def _read(texts: pa.Array, marks: pa.Array, units: pa.Array) -> pa.Array:
    quantities, values, stated, offsets = [], [], [], [0]
    for text, mark, declared in zip(texts.to_pylist(), marks.to_pylist(), units.to_pylist()):
        if text is not None and _DIGITS_OR_WORDS.search(text):
            for quantity, value, from_text in read_measurements(text, mark or ".", declared or ""):
                quantities.append(quantity)
                values.append(value)
                stated.append(from_text)
        offsets.append(len(quantities))
    each = pa.StructArray.from_arrays([pa.array(quantities, pa.string()), pa.array(values, pa.int64()), pa.array(stated, pa.bool_())], names=["quantity", "base_value", "unit_in_text"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)


#: Equal texts give equal arrays; it is marked nondeterministic as Spark would otherwise read each text again for a filter on the result.
_READ = _read.asNondeterministic()


def declared_units(units: DataFrame, source: str, quantity: str, unit: str) -> DataFrame:
    """(source, ``units``): what each source declares, as ``quantity=unit`` lines in one string."""
    lines = F.array_sort(F.collect_set(F.concat_ws("=", F.col(quantity), F.col(unit))))
    return units.where(F.col(quantity).isNotNull() & F.col(unit).isNotNull()).groupBy(source).agg(F.concat_ws("\n", lines).alias("units"))


def measurements(df: DataFrame, text: Column, decimal_mark: Column, units: Column, out_col: str = "measurements") -> DataFrame:
    """Adds ``array<struct<quantity, base_value bigint, unit_in_text>>``: the quantities a text states, in base units.

    Base units: latency microseconds, price millionths of a dollar per 1,000 tokens, context tokens, memory bytes, quality
    ten-thousandths, throughput tokens per hour, energy millijoules; values are exact, halves round up. A value without a
    unit in its text or among ``units``, or beyond a bigint, has a null ``base_value``. Null and blank texts give an empty array; a null decimal
    mark is a point; an existing ``out_col`` is replaced; other columns are kept and rows neither lost nor merged.
    """
    return df.withColumn(out_col, _READ(text, decimal_mark, units))


def with_declared(candidates: DataFrame, catalog_units: DataFrame, catalogs: DataFrame, out_col: str = "measurements") -> DataFrame:
    """``measurements`` of candidates (catalog_id, text) with the units and decimal marks of their catalogs."""
    declared = declared_units(catalog_units, "catalog_id", "quantity", "unit")
    marks = catalogs.select("catalog_id", "decimal_mark")
    sources = bounded_broadcast(marks.join(declared, "catalog_id", "full_outer"))
    return measurements(candidates.join(sources, "catalog_id", "left"), F.col("text"), F.col("decimal_mark"), F.col("units"), out_col)


def resolve_units(df: DataFrame, units: Mapping[str, Mapping[str, float]], identities: Sequence[Mapping[str, float]], tolerance: float = 0.02, out_col: str = "units") -> DataFrame:
    """Chooses the unit of each column by physical identities, minimising the sum of squared log residuals.

    ``units``: column -> unit -> size in base units. ``identities``: column -> exponent; the product of the base values to
    these powers is 1 (mass = density x volume: ``{"mass": 1, "density": -1, "volume": -1}``). Adds ``out_col``:
    ``struct<residual, unique, choice map<column,unit>, base map<column,double>>``. ``unique`` is false if another
    combination comes within ``tolerance`` of the best residual or a column lies in no identity. Null, zero or negative
    values leave out the identities they are in; if none is left, ``choice`` is null and ``unique`` false. The combinations
    (at most 4,096) are part of the plan, so that no row is shuffled and no Python runs.
    """
    names = list(units)
    options = [list(units[n].items()) for n in names]
    combos = list(itertools.product(*options))
    if not identities or not combos or len(combos) > 4096:
        raise ValueError("give at least one identity and at most 4,096 combinations of units")
    unknown = {c for i in identities for c in i} - set(names)
    if unknown:
        raise ValueError(f"no units for {sorted(unknown)}")
    log = {n: F.when(F.col(f"`{n}`") > 0, F.ln(F.col(f"`{n}`").cast("double"))) for n in names}
    measured = [sum((F.lit(float(p)) * log[c] for c, p in i.items()), F.lit(0.0)) for i in identities]
    held = unique_name(df, "_logs")
    logs = df.withColumn(held, F.array(*measured))
    scored = []
    for k, combo in enumerate(combos):
        size = {n: math.log(u[1]) for n, u in zip(names, combo)}
        shifts = [sum(p * size[c] for c, p in i.items()) for i in identities]
        residual = sum((F.coalesce(F.pow(F.col(held)[j] + F.lit(s), F.lit(2.0)), F.lit(0.0)) for j, s in enumerate(shifts)), F.lit(0.0))
        scored.append(F.struct(residual.alias("r"), F.lit(k).alias("k")))
    ranked = unique_name(df, "_ranked")
    best = logs.withColumn(ranked, F.slice(F.array_sort(F.array(*scored)), 1, 2))
    usable = F.exists(F.col(held), lambda x: x.isNotNull())
    covered = set().union(*(set(i) for i in identities)) >= set(names)
    all_held = F.forall(F.col(held), lambda x: x.isNotNull())
    choices = F.array(*(F.create_map(*[F.lit(x) for n, u in zip(names, combo) for x in (n, u[0])]) for combo in combos))
    sizes = F.array(*(F.array(*[F.lit(float(u[1])) for u in combo]) for combo in combos))
    k = F.col(ranked)[0]["k"]
    base = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{n}`").cast("double") * sizes[k][j] for j, n in enumerate(names))))
    unique = F.coalesce(F.lit(covered) & all_held & ((F.col(ranked)[1]["r"] - F.col(ranked)[0]["r"]) > tolerance), F.lit(covered) & all_held & F.lit(len(combos) == 1))
    out = F.struct(
        F.when(usable, F.col(ranked)[0]["r"]).alias("residual"), (usable & unique).alias("unique"), F.when(usable, choices[k]).alias("choice"), F.when(usable, base).alias("base")
    )
    return best.withColumn(out_col, out).drop(held, ranked)
