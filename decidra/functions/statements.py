"""Texts of questions: options, hypotheses, statements, prompts, asset placeholders. Native expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions.scores import readable

# Word classes of yes/no questions.
AUXILIARIES = "is are was were does do did has have had can could will would should may might must".split()
DETERMINERS = "the this that these those a an my our your their his her its any each every no some".split()
PRONOUNS = "i you we they he she it there".split()
PREDICATE_STARTS = (
    "about above across after against among around at before below between by for from in inside into near of on over to under with within without "
    "not very too also still currently already a an the this that these those any no some both all more less same likely able related regarding using be been being"
).split()
BARE_VERB_AFTER = "does do did can could will would should may might must".split()
IRREGULAR_PAST = {
    "say": "said", "go": "went", "get": "got", "make": "made", "take": "took", "give": "gave", "come": "came", "see": "saw", "pay": "paid", "buy": "bought", "send": "sent", "ask": "asked",
}
# Templates of prompts and of the two sides of a predicate.
PAIR_PROMPT, AXIS_PROMPT = "On axis {axis}: A = {a} B = {b}", "Axis: {axis}. Candidate: {text}"
SATISFIES, FAILS = "This option satisfies the {concept} requirement.", "This option does not satisfy the {concept} requirement."


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))


#: The subject of a question by shape: a pronoun, a determiner before another one, or a noun phrase with its "of" phrases
#: and at most one noun more; the predicate keeps at least one word, which the pattern gets by giving words back.
_DET = rf"(?:{_any(DETERMINERS)})"
_NOUN_PHRASE = rf"(?:{_DET}\s+)?\S+(?:\s+of(?:\s+{_DET}(?=\s))?\s+\S+)*"
_MORE = rf"(?:\s+(?!(?:{_any([*PREDICATE_STARTS, *AUXILIARIES, *DETERMINERS])})\s)(?!\S*(?:ing|ed)\s)\S+(?=\s))?"


def _question(more: str) -> str:
    return rf"(?is)^({_any(PRONOUNS)}|{_DET}(?=\s+{_DET}\s)|{_NOUN_PHRASE}{more})\s+(\S.*)$"


def third_person(verb: Column) -> Column:
    """The form of a verb behind he, she or it."""
    v = F.lower(verb)
    return F.when(v == "have", "has").when(v.rlike("(s|x|z|ch|sh|o)$"), F.concat(v, F.lit("es"))).when(v.rlike("[^aeiou]y$"), F.regexp_replace(v, "y$", "ies")).otherwise(F.concat(v, F.lit("s")))


def past(verb: Column) -> Column:
    v = F.lower(verb)
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR_PAST.items() for x in kv])
    regular = F.when(v.endswith("e"), F.concat(v, F.lit("d"))).when(v.rlike("[^aeiou]y$"), F.regexp_replace(v, "y$", "ied")).otherwise(F.concat(v, F.lit("ed")))
    return F.coalesce(known[v], regular)


def to_statement(question: Column) -> Column:
    """A yes/no question as a statement; all other texts come back trimmed, null as an empty text.

    "Does this message express urgency?" becomes "This message expresses urgency."
    """
    text = F.trim(F.coalesce(question, F.lit("")), F.lit(" \t\r\n"))
    shape = rf"(?is)^({_any(AUXILIARIES)})\s+(\S+\s.*?\S)\s*\?$"
    aux = F.lower(F.regexp_extract(text, shape, 1))
    rest = F.regexp_replace(F.regexp_extract(text, shape, 2), r"\s+", " ")
    split = lambda more: (F.regexp_extract(rest, _question(more), 1), F.regexp_extract(rest, _question(more), 2))
    bare = aux.isin(*BARE_VERB_AFTER)
    subject, predicate = (F.when(bare, short).otherwise(long) for short, long in zip(split(""), split(_MORE)))
    head = F.substring_index(subject, " of ", 1)
    plural = head.rlike(r"(?i)(?:^|\s)(?:i|you|we|they|these|those)$|[a-z]s$")
    verb, tail = F.substring_index(predicate, " ", 1), F.regexp_extract(predicate, r"(?s)^\S+(.*)$", 1)
    form = F.when(aux == "did", past(verb)).when((aux == "do") | plural, verb).otherwise(third_person(verb))
    said = F.when(aux.isin("does", "do", "did"), F.concat(form, tail)).otherwise(F.concat_ws(" ", aux, predicate))
    upper = F.concat(F.upper(F.substring(subject, 1, 1)), F.substring(subject, 2, 1_000_000))
    whole = F.concat(F.rtrim(F.concat_ws(" ", upper, said), F.lit(".")), F.lit("."))
    return F.when((aux != "") & (subject != "") & (predicate != ""), whole).otherwise(text)


def option_text(kind: Column, key: Column, description: Column) -> Column:
    """"name: description" of a choice, the description or "level k" of a score."""
    said = F.nullif(F.trim(F.coalesce(description, F.lit(""))), F.lit(""))
    return F.when(kind == "score", F.coalesce(said, F.concat(F.lit("level "), key))).otherwise(F.concat_ws(": ", readable(key), said))


def hypothesis(key: Column, description: Column) -> Column:
    """What a text would be an example of: the first letter is lowered unless two capitals begin it."""
    said = F.nullif(F.trim(F.coalesce(description, F.lit(""))), F.lit(""))
    lowered = F.when(F.substring(said, 1, 2).rlike(r"^\p{Lu}{1,2}$") & ~F.substring(said, 1, 2).rlike(r"^\p{Lu}\P{Lu}"), said).otherwise(
        F.concat(F.lower(F.substring(said, 1, 1)), F.substring(said, 2, 1_000_000))
    )
    return F.when(said.isNull(), F.concat(F.lit("This example is "), readable(key), F.lit("."))).otherwise(F.concat(F.lit("This example is "), F.rtrim(lowered, F.lit(".")), F.lit(".")))


def _filled(template: str, **values: Column) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p))


def pair_prompt(axis: Column, a: Column, b: Column) -> Column:
    return _filled(PAIR_PROMPT, axis=axis, a=a, b=b)


def axis_prompt(axis: Column, text: Column) -> Column:
    return _filled(AXIS_PROMPT, axis=axis, text=text)


def predicate_sides(concept: Column) -> tuple[Column, Column]:
    """The proposition that a concept holds, and that it does not."""
    return _filled(SATISFIES, concept=concept), _filled(FAILS, concept=concept)


def _placeholders(names: Column) -> Column:
    """A pattern of whole placeholders, the longest first; one that never matches where there are none."""
    some = F.filter(F.coalesce(names, F.expr("cast(array() as array<string>)")), lambda n: n != "")
    ordered = F.array_sort(F.transform(some, lambda n: F.struct((-F.length(n)).alias("l"), F.regexp_replace(n, r"([\\\[\](){}.*+?^$|])", r"\\$1").alias("n"))))
    return F.when(F.size(some) > 0, F.concat(F.lit(r"(?<!\w)(?:"), F.array_join(F.transform(ordered, lambda x: x["n"]), "|"), F.lit(r")(?!\w)"))).otherwise(F.lit(r"(?!)"))


def with_assets(text: Column, names: Column, said: str = "the attached image") -> Column:
    """The text with placeholders of assets replaced; null if it is nothing but one placeholder."""
    alone = F.array_contains(F.coalesce(names, F.expr("cast(array() as array<string>)")), F.trim(text))
    return F.when(~F.coalesce(alone, F.lit(False)), F.regexp_replace(text, _placeholders(names), F.lit(said)))


def assets_in(text: Column, names: Column) -> Column:
    """The placeholders that a text mentions, in the order in which they first appear."""
    return F.array_distinct(F.regexp_extract_all(text, _placeholders(names), F.lit(0)))
