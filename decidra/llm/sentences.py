"""Sentence boundaries across languages and scripts, in SQL expressions only.

Method: decimals, URLs, addresses, initials, abbreviations and quoted speech are masked with private-use placeholders
of the same length, a terminator regex for each kind of script puts a mark behind each sentence, and the text is
restored by position: as every mask keeps its length, the end of a sentence in the masked text is its end in the text.
No Python runs and nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.session import unique_name

# Private-use placeholders. Marks of one kind become one range, so that the patterns stay simple.
DOT, STOP, MARK = "\ue000", "\ue001", "\ue0ff"
_TERMS, _OPENERS, _CLOSERS, _SPACES = "。！？।؟…", "“„«「『（", "”»」』）", "\u00a0\u2009\u202f\u3000"
#: Private-use characters of the text itself, which would pass for placeholders, become one that is none.
_OWN = "".join(map(chr, range(0xE000, 0xE100)))
_FROM = _TERMS + _OPENERS + _CLOSERS + _SPACES + _OWN
_TO = "".join(chr(k + i) for k, marks in ((0xE010, _TERMS), (0xE020, _OPENERS), (0xE030, _CLOSERS)) for i in range(len(marks))) + " " * len(_SPACES) + "\uf8ff" * len(_OWN)
_WIDE, _ELLIPSIS = "\ue010-\ue013", "\ue015"
_TERM, _OPEN, _CLOSE, _WS = ".!?\ue010-\ue015", r"(\[" + "\ue020-\ue025", r")\]" + "\ue030-\ue034\ue020", r" \n\t\r"  # “ closes in German

# Abbreviations after which a sentence goes on, whatever follows.
ABBREVIATIONS = (
    "Fig Figs No Nos Nr Nrn núm Núm num vs approx ca Ca cf Cf cfr vgl Vgl Abb Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "Mr Mrs Ms Dr Prof Sr Sra Srta Sig sig Mme Mlle env Env aprox Aprox appr pag Pag pág Pág págs pagg blz Blz bijv Bijv "
    "ung Ung kl Kl стр Стр стор Стор прибл Прибл прим рис Рис мал ул вул тов incl inkl Inkl excl bzw usw evtl ggf sog u.a "
    "Apt apt Tel tel Tél tél Av av Avda avda Avd avd bld Bld ad es esp ej ex Ex p.ex Hr Fr dhr mevr hr hs nº et al Bl Nro nro ext Ext "
    "ред ст пр просп"
)
# Abbreviations after which a sentence goes on if a number or a lower-case word follows.
UNIT_ABBREVIATIONS = "Mio Mrd Tsd str Str sec min Sek Min Inc Ltd Co Corp etc ecc bl Rd Ave St Ln Blvd Sq"
# Months that follow an ordinal written with a point.
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember"

_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def _words(text: str) -> str:
    return "|".join(sorted(set(text.split()), key=lambda w: (-len(w), w))).replace(".", r"\.")


# Abbreviations before a number or a code, otherwise words.
NUMBER_ABBREVIATIONS = "no No NO nr Nr NR nos Nos art Art sec Sec p P S s pos Pos"


def _points() -> str:
    """The points that end no sentence, each matched by itself, so that the text is scanned for points only."""
    ws, abbr, units, numbers = f"[{_WS}]", _words(ABBREVIATIONS), _words(UNIT_ABBREVIATIONS), _words(NUMBER_ABBREVIATIONS)
    word = r"(?<![\p{L}\p{N}])"
    longer = _words(" ".join(w for w in ABBREVIATIONS.split() if len(w) > 4 and w[-5:].islower()))
    return rf"\.(?![{_WS}]*+\z)" + r"(?:(?=\p{Nd})(?<!\p{L}\.)|" + rf"(?<={word}(?:{longer})\.)(?={ws}*[^{_WS}])|(?<=\p{{L}}[sS]tr\.)(?={ws}+[\p{{Ll}}\p{{Nd}}]|[,;)])" + r"|(?<!\p{Ll}{5}\.)(?:" + "|".join((  # most sentences end in a longer word: these points are passed over at once
        r"(?<=[@＠]\s?[\p{L}\p{N}.\-]{1,50}\.)(?=\p{L}{2})",  # the host of an address
        rf"(?<=(?:^|\n)[ \t]{{0,8}}\p{{Nd}}{{1,3}}\.)(?=[ \t])",  # the number of a list item
        rf"(?<={word}\p{{Nd}}{{1,2}}\.)(?={ws}+(?:{_words(MONTHS)})\b)",
        rf"(?<={word}(?:{abbr})\.)(?={ws}*[^{_WS}])",
        rf"(?<={word}(?:{numbers})\.)(?={ws}*(?:\p{{Nd}}|\p{{Lu}}{{1,2}}{ws}?\p{{Nd}}))",
        rf"(?<=(?<!\p{{L}})(?:{units})\.)(?={ws}+[\p{{Ll}}\p{{Nd}}|]|{ws}+(?:[Tt]oken|[Jj]eton)|[,;)])",
        rf"(?<=(?:^|[\n(]|[(,;:\p{{L}}]{ws}{{1,2}}|\p{{Ll}}[.{DOT}]{ws}{{0,2}})\p{{Ll}}\.)(?={ws}?[\p{{L}}\p{{N}}°º])",  # "z. B.", "p. ex.", "i.e."
        rf"(?<={word}\p{{Lu}}\.)(?=\p{{Lu}}\.)",
        rf"(?<=(?:\p{{L}}{ws}{{1,2}}|^|\n|[,{_TERM}]{ws}{{1,2}})\p{{Lu}}\.)(?={ws}+\p{{Lu}})",  # initials
    )) + "))"


#: Points and other terminators inside an address of the web, but for those at its end.
_URL = rf"((?:(?:https?|ftp)://|(?<![\p{{L}}\p{{N}}.])www)[^\s.!?]*+|(?!\A)\G[^\s.!?]*+)[.!?](?=[\p{{L}}\p{{N}}/_?&=%#~+\-])"
#: Straight quotation marks in pairs, with no blank line between: an opening and a closing one.
_STRAIGHT = r"(?<![^\s(\[\ue020-\ue025])\"(?=\S)((?:[^\"\n]++|\n(?![ \t\r]*\n))*+)\"(?![\p{L}\p{N}])"
#: Terminators inside quoted or bracketed speech, but for the last run before the closing mark; what is open closes before a blank line.
_CLOSED = rf"(?=(?:[^{_OPEN}{_CLOSE}\n]++|\n(?![ \t\r]*\n))*+[{_CLOSE}])"
_SPEECH = rf"([{_OPEN}]{_CLOSED}[^{_OPEN}{_CLOSE}{_TERM}]*+|(?!\A)\G[^{_OPEN}{_CLOSE}{_TERM}]*+)[{_TERM}](?![{_TERM}]*+ ?[{_CLOSE}])"
_SPEECH_SINGLE = rf"(‘(?=(?:[^‘’\n]++|\n(?![ \t\r]*\n))*+’)[^‘’{_TERM}\n]*+|(?!\A)\G[^‘’{_TERM}\n]*+)[{_TERM}](?![{_TERM}]*+ ?’)"
#: Behind each sentence a mark, by kind of script: the first alternative holds for all, the last ones for scripts without
#: spaces or without case. An interjection with dots at the start of a sentence ("Well... ") ends none.
TERMINATORS = (
    rf"[{_TERM}]++(?:(?<!\.\.\.|{_ELLIPSIS})|(?<!(?:^|[\n\-*•{_TERM}{_CLOSE}][{_WS}]{{0,3}})\p{{Lu}}\p{{Ll}}{{1,7}}(?:\.\.\.|{_ELLIPSIS})))(?:"
    rf"(?=[{_WS}]++[^|,;:=\p{{Ll}}{_CLOSE}]|[{_WS}]*+\z)"
    rf"| ?[{_CLOSE}’]++(?=[{_WS}]++[\p{{Lu}}\p{{Nd}}{_OPEN}•*¿¡+☎‘\-]|[{_WS}]*+\z|[ \t\r]*+\n[ \t\r]*+\n)"
    rf"|(?<=\p{{L}}{{4}}[{_TERM}]{{1,6}})(?=[{_WS}]++\p{{Ll}})"
    rf"|(?<=[{_WIDE}])(?! ?[{_CLOSE}’])"
    rf"|(?<=\p{{IsArabic}}[{_TERM}]{{1,6}})(?=\p{{IsArabic}})"
    rf"|(?<={_ELLIPSIS}{{2}}|[{_CJK}][.!?]{{1,6}})(?=[{_CJK}])"
    rf"|(?<=[\p{{Ll}}\p{{Nd}})][.!?]{{1,6}})(?=\p{{Lu}}\p{{Ll}}))"
)
#: In Thai a space parts statements if Thai letters, a number or a quotation stand before and Thai letters behind it.
THAI_SPEECH = rf"([{_OPEN}](?=[^{_OPEN}{_CLOSE}\n]*+[{_CLOSE}])[^{_OPEN}{_CLOSE} \n]*+|(?!\A)\G[^{_OPEN}{_CLOSE} \n]*+) "
THAI = rf"(?<=[\p{{IsThai}}\p{{Nd}}{_CLOSE}])(?= ++\p{{IsThai}})"
#: Lines that end a sentence: blank lines, a colon, list items, and the lines of a closing block without marks (a signature:
#: up to eight lines of up to 90 characters at the end of the text).
LINES = (
    r"\n(?:[ \t\r]*+\n|(?<=[:：][ \t\r]{0,3}\n)"
    rf"|(?=[ \t]*+(?:[-*•]|\d{{1,3}}\)|\d{{1,3}}{DOT})[ \t])"
    rf"|(?=[\p{{Lu}}\p{{N}}+(☎]|[^\n]{{0,60}}(?:[@＠]|\(at\)|\[at\]| at ))(?=[^\n{MARK}]{{1,90}}(?:\n[^\n{MARK}]{{1,90}}){{0,7}}{MARK}?\z))"
)
_BLANKS = " \t\r\n\u00a0\u202f\u2009\u3000\x0b\x0c"


#: An opening mark with a terminator before the next mark.
_OPEN_TERM = rf"[{_OPEN}][^{_OPEN}{_CLOSE}{_TERM}]*+[{_TERM}]"


def _where(condition: Column, masked: Column, *steps: tuple[str, str], found: str | None = None) -> Column:
    """``masked`` after the steps (pattern, replacement) where the condition holds and ``found`` occurs; it is computed once."""

    def then(x: Column) -> Column:
        changed = x
        for pattern, replacement in steps:
            changed = F.regexp_replace(changed, F.lit(pattern), F.lit(replacement))
        return F.when(condition & x.rlike(found) if found else condition, changed).otherwise(x)

    return F.get(F.transform(F.array(masked), then), F.lit(0))


def marked(text: Column) -> Column:
    """The masked text, of the same length in code points, with a mark behind each sentence."""
    plain = F.octet_length(text) == F.length(text)  # the marks that are translated are not ASCII
    holds = lambda marks: reduce(or_, (F.contains(text, F.lit(m)) for m in marks))
    out = F.rtrim(F.when(plain, text).otherwise(F.translate(text, _FROM, _TO)), F.lit(" \n\t\r"))
    out = _where(holds('"'), out, (_STRAIGHT, "\ue021$1\ue030"))
    out = _where(holds(("://", "www.")), out, (_URL, "$1" + STOP))
    out = F.regexp_replace(out, F.lit(_points()), F.lit(DOT))
    out = _where(holds('([\"') | (~plain & holds(_OPENERS)), out, (_SPEECH, "$1" + STOP), found=_OPEN_TERM)
    out = _where(~plain & holds("‘"), out, (_SPEECH_SINGLE, "$1" + STOP))
    out = _where(~plain & text.rlike(r"[\u0e01-\u0e5b]"), out, (THAI_SPEECH, "$1" + STOP), (THAI, MARK))
    return F.regexp_replace(F.regexp_replace(out, F.lit(TERMINATORS), F.lit("$0" + MARK)), F.lit(LINES), F.lit(MARK + "$0"))


def sentence_ends(text: Column) -> Column:
    """``array<int>``: the position of each sentence's last character, counted in code points from 1.

    Null text gives null, blank text an empty array. Equal texts give equal arrays; length is not limited.
    """
    pieces = F.split(marked(text), MARK)
    start = F.struct(F.expr("cast(array() as array<int>)").alias("ends"), F.lit(0).alias("at"))

    def step(acc: Column, piece: Column) -> Column:
        held = F.length(F.rtrim(piece, F.lit(" \n\t\r")))
        return F.struct(F.when(held == 0, acc["ends"]).otherwise(F.concat(acc["ends"], F.array(acc["at"] + held))).alias("ends"), (acc["at"] + F.length(piece)).alias("at"))

    return F.when(text.isNotNull(), F.aggregate(pieces, start, step, lambda acc: acc["ends"]))


def split_sentences(df: DataFrame, text_col: str, out_col: str = "sentences") -> DataFrame:
    """Adds ``array<struct<start:int,end:int,text:string>>``: the sentences of each text, white space around them cut.

    Null texts give null, blank texts an empty array, repeated rows stay repeated. An existing ``out_col`` is replaced;
    all other columns are kept as they are.
    """
    text, held = F.col(f"`{text_col}`"), unique_name(df, "_ends")
    ends = F.col(held)
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))

    def cut(start: Column, end: Column) -> Column:
        raw = F.substring(text, start + 1, end - start)
        lead = F.length(raw) - F.length(F.ltrim(raw, F.lit(_BLANKS)))
        return F.struct((start + 1 + lead).cast("int").alias("start"), end.alias("end"), F.ltrim(raw, F.lit(_BLANKS)).alias("text"))

    whole = F.when(F.size(ends) > 0, F.zip_with(starts, ends, cut)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))
    return df.withColumn(held, sentence_ends(text)).withColumn(out_col, F.when(text.isNotNull(), whole)).drop(held)
