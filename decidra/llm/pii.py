"""Personal information inside free text: detection, typed placeholders, and keyed surrogates.

Patterns of formats find e-mail addresses, phone numbers, identity numbers and street addresses. Full names are found by
evidence that adds up: a given name of a general list, a phrase or title that introduces a person, a closing formula in
front, a verb of persons behind, an e-mail address in the same text whose local part spells the name, and a name found
next to it. Each entity gets a surrogate from a keyed hash: the same entity in another spelling (case, order, spacing) gets
the same one wherever it occurs; numbers keep layout, width and leading zeros, addresses their form and postal code, names
the gender of their given name, order and case. A check over all entities parts those whose surrogates collide, and only
checked surrogates are written into texts.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.session import cut_lineage

# Common given names of many countries by gender (f, m); longer lists can be passed in.
GIVEN_F = (
    "Greta Elisa Ilva Liora Clara Rhea Nora Sanne Thea Léa Mirela Zoë Nadja Dora Noémie Paula Marla Ines Wanda Freya Selma Åsa Vera Maren "
    "Ada Agnes Aisha Alice Alicia Amanda Amelia Amina Amy Ana Andrea Angela Anita Anja Anna Anne Annika Antonia Astrid Barbara Beatriz Birgit Brigitte Camila Camille Carla Carmen Carolina Caroline "
    "Catarina Cécile Charlotte Chiara Chloé Christine Claudia Cristina Daniela Deborah Diana Dorothea Elena Eleonora Elif Elizabeth Ella Elsa Emilia Emily Emma Esther Eva Fatima Federica Fernanda Fiona "
    "Francesca Françoise Gabriela Giulia Hanna Hannah Heidi Helen Helena Helga Ida Ingrid Irene Isabel Isabella Jana Jane Jennifer Jessica Joana Johanna Julia Juliette Karen Karin Katarina Katharina Kavita "
    "Kristina Lara Larissa Laura Leila Lena Leonie Lidia Linda Lisa Lotte Louise Lucía Lucie Lucy Luisa Magdalena Manon Margaret Margarida María Maria Mariana Marie Marta Martina Mary Mathilde Megan Mei Melissa "
    "Mia Michelle Mónica Monika Nadia Natalia Nicole Nina Olga Olivia Patricia Petra Priya Rachel Rebecca Renata Rosa Ruth Sabine Sandra Sara Sarah Saskia Silvia Simone Sofia Sofía Sonia Sophie Stefanie Susan "
    "Svetlana Sylvie Tamara Tanja Tatiana Teresa Ursula Valentina Valeria Veronica Victoria Yasmin Yuki Zara"
)
GIVEN_M = (
    "Iñigo Joren Anton Rufus Silas Jonas Tomas Oskar Orin Victor Felix Tavik Luca Aldo Henrik Pavel Jürgen Kasper Emil Matteo Yannick Bram "
    "Aaron Abdul Adam Adrian Ahmed Alan Alberto Alejandro Alessandro Alex Alexander Ali Anders Andreas Andrew Angelo Antoine António Antonio Arjun Arthur Axel Barack Benjamin Bernd Björn Boris Bruno Carlos Charles "
    "Christian Christoph Claude Daniel Dario David Davide Diego Dieter Dmitri Edward Enrico Eric Erik Ernesto Étienne Fabian Fabio Federico Fernando Filip Florian Francesco Francisco François Franz Frederik Fritz "
    "Gabriel Georg George Gérard Giorgio Giovanni Giuseppe Gregor Guido Günter Gustav Hans Harald Hassan Heinrich Helmut Henry Hiroshi Hugo Ibrahim Igor Ivan Jacob Jakob James Jan Jason Javier Jens Jeroen João "
    "Joaquín Joe Johan Johann Johannes John Jorge José Joseph Joshua Juan Julian Julien Jun Karl Kenji Kevin Klaus Konrad Kurt Lars Laurent Leo Leon Leonardo Lorenzo Luc Lucas Luigi Luis Lukas Maarten Magnus "
    "Manuel Marc Marcel Marco Mario Martin Matthew Matthias Maurice Michael Michel Miguel Mikael Mohammed Moritz Nicolas Niels Nikolai Nils Noah Olaf Oleg Oliver Olivier Omar Otto Pablo Paolo Patrick Paul Pedro "
    "Peter Philip Philippe Pierre Rafael Rahul Rainer Rajesh Ralf Raúl René Ricardo Richard Robert Roberto Rolf Ruben Samuel Sebastian Sergei Sergio Simon Stefan Stéphane Steven Sven Takeshi Thomas Tim Timo "
    "Tobias Ulrich Vincent Vladimir Walter Werner William Wolfgang Yusuf"
)
# Given names that are words as well, which in small letters count behind a phrase that introduces a person only.
ALSO_WORDS = "ada alan ali alex angelo claude dario joe jun jan jana lara leo linda luc max mei mia mary nils nina noah otto paul peter rosa ruth sara sandra simon sven tim timo jane marc marie andrea guido konrad".split()
# Phrases and titles right before a person's full name.
INTRODUCTIONS = (
    "My name is|Je m[’']appelle|Me llamo|Mein Name ist|Mi chiamo|Chamo-me|Jag heter|Mijn naam is|filled in by|gehört|belongs to|tillhör|"
    "Please ask for|cc|You can reach|Sie erreichen|lo firmó|"
    r"Mr\.|Mrs\.|Ms\.|Dr\.|Herr(?: Dr\.)?|Frau(?: Dr\.)?|Mme|Mlle|La Sra\.|El Sr\.|"
    r"\"who\": \""
)
# Closing formulas and requests with a person's full name behind, and verbs of persons behind one.
CLOSINGS = (
    "Regards|Best regards|Kind regards|Sincerely|Yours|Thanks|Cheers|Contact|contact|Signed|signed by|Grüße|Viele Grüße|Mit freundlichen Grüßen|Kontakt|Cordialement|Bien à vous|Saludos|Un saludo|Atentamente|"
    "Cordiali saluti|Saluti|Atenciosamente|Abraços|Groeten|Met vriendelijke groet|Hälsningar|Med vänliga hälsningar"
)
PERSON_VERBS = (
    "lives|lived|works|worked|called|wrote|writes|met|meets|phoned|says|said|asked|asks|replied|signed|moved|wohnt|arbeitet|schrieb|traf|sagt|habite|travaille|écrit|rencontra|vive|trabaja|escribió|abita|lavora|"
    "ha scritto|mora|trabalha|escreveu|woont|werkt|schreef|bor|arbetar|skrev"
)
_TITLES = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Sra|Sr|M|Sig|sig)\.|Herr|Frau|Mme|Mlle|Monsieur|Madame|de heer|mevrouw)"
_W = "A-Za-z0-9À-ÖØ-öø-ɏ"
_AT, _ATX = r"(?:@|＠| @ | ＠ | ?\(at\) ?| ?\[at\] ?)", r" at "
_DOTX = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
_HOST = rf"(?:[a-z0-9\-]+(?:{_DOTX}[a-z0-9\-]+)*{_DOTX}[a-z]{{2,}}|[A-Z0-9\-]+(?:{_DOTX}[A-Z0-9\-]+)*{_DOTX}[A-Z]{{2,}})"
EMAIL = re.compile(
    rf"(?<![{_W}._%+\-])[{_W}](?:[{_W}._%+\-]*[{_W}])?(?:{_AT}{_HOST}|{_ATX}(?:[a-z0-9\-]+ dot )+[a-z]{{2,}}|{_ATX}(?:[A-Z0-9\-]+ dot )+[A-Z]{{2,}})(?![A-Za-z0-9@])"
)
_D = "0-9０-９"
_SEP = r"[ .\-–/－．\u00a0\u202f]"
PHONE = re.compile(
    rf"(?<![{_D}A-Za-z#№.,\-])(?<![{_D}]{_SEP})(?:"
    rf"(?:[+＋]|[0０][0０])[{_D}]{{1,3}}{_SEP}?(?:[(（][{_D}]{{1,4}}[)）]{_SEP}?)?[{_D}]{{1,5}}(?:{_SEP}?[{_D}]{{2,8}}){{1,5}}"  # international
    rf"|[+＋][{_D}]{{8,14}}"
    rf"|(?:[1１]{_SEP})?[(（]?[2-9２-９][{_D}]{{2}}[)）]?{_SEP}[{_D}]{{3}}{_SEP}[{_D}]{{4}}"  # 3-3-4
    rf"|[(（][0０][{_D}]{{1,5}}[)）]{_SEP}?[{_D}]{{3,8}}(?:{_SEP}[{_D}]{{2,6}}){{0,3}}"  # (030) ...
    rf"|[0０][{_D}]{{2,4}}{_SEP}[{_D}]{{3,8}}(?:{_SEP}[{_D}]{{3,4}}){{0,2}}"  # 020 7946 0421, 030/231255
    rf"|[0０][1-9１-９](?:{_SEP}[{_D}]{{2}}){{4}}"  # pairs
    rf")(?![{_D}])(?!{_SEP}[{_D}])"
)
ID_NUMBER = re.compile(
    r"(?<![0-9A-Za-z.,\-/#+])(?<![0-9][ .\-])(?:"
    r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]"
    r"|[XYZKLM][0-9]{8}|[0-9]{8}[A-Z]|[0-9]{2}\.[0-9]{3}\.[0-9]{3}-?[A-Z]"
    r"|[0-9]{3}([\- ])[0-9]{2}\1[0-9]{4}"
    r"|[0-9]{4}([\- ])[0-9]{4}\2[0-9]{4}"
    r"|[0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}"
    r"|[1-37-8] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}"
    r"|[0-9]{17}[0-9X]|[0-9]{11}|[0-9]{9}"
    r")(?![0-9A-Za-z\-])(?![ .\-][0-9])"
)
_NOT_ID = re.compile(r"(?:article|artículo|artikel|artigo|articolo|order|pedido|commande|auftrag|ordine|ticket|total|lane|#)\W*(?:\w+\W+)?$", re.I)
_UP = "A-ZÀ-ÖØ-Þ"
_TOWN = rf"[{_UP}][\w’'\-]+"
_PLACE = rf"(?:[0-9]{{5}}\s{_TOWN}|{_TOWN}\s[0-9]{{5}}(?![0-9])|{_TOWN})"
_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Drive|Dr|Boulevard|Blvd|Place|Square|Terrace|Way"
#: Street addresses by form, each with the words of which one must stand in the text, and ends of words likewise.
ADDRESSES = [(frozenset(whole), ends, re.compile(pattern)) for whole, ends, pattern in (
    ([*_EN.split('|'), *_EN.upper().split('|')], (), rf"(?:(?:Flat|FLAT|Apt\.?|Unit)\s[0-9]+[A-Za-z]?,\s)?(?<![0-9.,\-])[0-9]{{1,4}}[A-Za-z]?\s{_TOWN}\s(?:{_EN}|{_EN.upper()})\b\.?(?:,\s(?:Apt|APT|Flat|FLAT|Unit)\.?\s[0-9]+[A-Za-z]?)?(?:,\s|\s(?:in|IN)\s){_PLACE}"),
    ((), ("str.", "straße", "strasse", "STRASSE", "STRAẞE", "STR.", "gasse", "GASSE", "weg", "WEG", "allee", "platz", "straat", "STRAAT", "laan", "gracht", "gatan", "GATAN", "vägen", "VÄGEN"), rf"\b{_TOWN}(?:str\.|straße|strasse|STRASSE|STRAẞE|STRASSE|STR\.|gasse|GASSE|weg|WEG|allee|platz|straat|STRAAT|laan|gracht|gatan|GATAN|vägen|VÄGEN)\s[0-9]{{1,4}}\s?[A-Za-z]?,\s{_PLACE}"),
    ("rue av avenue chemin boulevard bd place allée RUE AV AVENUE CHEMIN".split(), (), rf"(?<![0-9.,\-])[0-9]{{1,4}}(?:\s(?:bis|ter|BIS|TER))?,?\s(?:rue|av\.|avenue|chemin|boulevard|bd|place|allée|RUE|AV\.|AVENUE|CHEMIN)\s(?:(?:des|de|du|la|le|les|DES|DE|DU|LA)\s|d[’']|l[’'])*{_TOWN},\s{_PLACE}"),
    ("C Calle Avda Avenida Av Plaza Paseo CALLE AVDA Via Viale Piazza Corso V VIA VIALE Rua R Travessa RUA AVENIDA".split(), (), rf"\b(?:C/|Calle|Avda\.|Avenida|Av\.|Plaza|Paseo|CALLE|AVDA\.|Via|Viale|Piazza|Corso|V\.le|VIA|VIALE|Rua|R\.|Travessa|RUA|AVENIDA)\s(?:(?:de|da|do|di|del|della|la)\s)*{_TOWN},?\s(?:n\.?º?\s?)?[0-9]{{1,4}}[A-Za-z]?(?:,\s[0-9]{{1,2}}\.?[ºª°](?:\s[A-Z]\b|\s(?:izq|dcha|esq|dto)\.?)?)?,\s{_PLACE}"),
)]


_L = r"[^\W\d_]"
_SUR = rf"(?:(?:van\s+der|van\s+den|van|von|de|di|da|del|VAN\s+DER|VON|DE)\s+)?(?:[OD][’']|o[’'])?(?:[{_UP}]{_L}+)(?:-(?:[OD][’'])?[{_UP}]{_L}+)*"
_SUR_LOW = rf"(?:(?:van\s+der|van\s+den|van|von|de|di|da|del)\s+)?(?:o[’']|d[’'])?{_L}{{3,}}(?:-{_L}+)*"


_AHEAD, _BEHIND = re.compile(rf"(?<![\w@＠.+\-])|(?<=[a-z0-9][.!?])(?=[{_UP}])"), r"(?![\w@＠])(?!\.[a-z0-9])"
_WORDS = re.compile(rf"{_L}+")
_REST, _REST_LOW = re.compile(rf"(?:\s[{_UP}]\.)?\s{_SUR}{_BEHIND}"), re.compile(rf"(?:\s[a-z]\.)?\s{_SUR_LOW}{_BEHIND}")
_LAST, _LAST_LOW = re.compile(rf"(?:{_SUR},[ \u00a0]|(?<![\n]){_SUR},\n)\Z"), re.compile(rf"{_L}{{4,}}(?:-{_L}+)*,[ \u00a0]\Z")
_AFTER, _AFTER_LOW = re.compile(rf"(?:\s[{_UP}]\.)?(?![\w@＠])(?!\s{_SUR}\s(?:{_EN})\b)"), re.compile(r"(?![\w@＠])")
_FULL = rf"[{_UP}]{_L}+(?:-[{_UP}]{_L}+)*(?:\s[{_UP}]\.|\s[{_UP}]{_L}+(?:-[{_UP}]{_L}+)*)?\s{_SUR}"


class Names:
    """Finds full names; built once per task."""

    def __init__(self, given: list[str]) -> None:
        self.proper = {v for n in given for v in (n, n.upper())}
        self.lower, self.unsure = {n.lower() for n in given}, set(ALSO_WORDS)
        self.closings = {w.split()[-1] for w in CLOSINGS.split("|")} | set(CLOSINGS.split("|"))
        self.led = re.compile(rf"(?<!\w)(?:{INTRODUCTIONS}|{CLOSINGS})[,:]?\s?(?:{_TITLES}\s)*\Z")
        self.any = self.proper | self.lower
        told = rf"(?:{INTRODUCTIONS})\s?(?:{_TITLES}\s)*(?P<told>{_FULL})(?![\w@＠])"
        closed = rf"(?:{CLOSINGS})(?:[,:]\s{{0,2}}|\s)(?:{_TITLES}\s)*(?P<closed>{_FULL})(?=\s*(?:\n|\Z|[.,;])|\s[a-z])"
        self.told = re.compile(rf"(?<!\w)(?:{told}|{closed})")
        self.verb, self.verbs = re.compile(rf"(?<![\w@.'’&-])(?P<told>{_FULL})\Z"), re.compile(rf"\s(?:{PERSON_VERBS})\b")

    def by_given(self, text: str, words: set[str]) -> list[tuple[int, int]]:
        """Names with a known given name, in either order."""
        found, upto = [], 0
        if self.any.isdisjoint(words):
            return found
        for m in _WORDS.finditer(text):
            word, (a, b) = m[0], m.span()
            if a < upto or word not in self.any:
                continue
            small = word in self.lower
            if word in self.unsure and not self.led.search(text, max(0, a - 40), a):
                continue
            known = self.lower if small else self.proper
            second = _WORDS.match(text, b + 1) if text[b : b + 1].isspace() else None
            second = second.end() if second and second[0] in known else None
            if text[a - 2 : a - 1] == "," or text[a - 1 : a] == ",":
                low = max(upto, a - 80)
                last = self._before(_LAST_LOW if small else _LAST, text[low:a])
                if last is not None and _AHEAD.match(text, low + last) and text[low + last : a].split(",")[0] not in self.closings:
                    end = second if second and _AFTER_LOW.match(text, second) else b
                    if rest := (_AFTER_LOW if small else _AFTER).match(text, end):
                        found.append((low + last, rest.end()))
                        upto = rest.end()
                        continue
            if _AHEAD.match(text, a):
                forward = _REST_LOW if small else _REST
                if rest := (forward.match(text, second) if second else None) or forward.match(text, b):
                    found.append((a, rest.end()))
                    upto = rest.end()
        return found

    @staticmethod
    def _before(pattern: re.Pattern, text: str) -> int | None:
        """Where the longest match that ends with the text begins."""
        m = pattern.search(text)
        return m.start() if m else None

    def by_context(self, text: str, mails: list[str]) -> list[tuple[int, int]]:
        """Names behind a phrase, before a verb of persons, or spelled by an e-mail address of the text."""
        found = [m.span(m.lastgroup) for m in self.told.finditer(text)]
        for v in self.verbs.finditer(text):
            m = self.verb.search(text, max(0, v.start() - 80), v.start()) if text[v.start() - 1 : v.start()].isalpha() else None
            if m and m["told"].split()[0] not in _NO_GIVEN:
                found.append(m.span("told"))
        for mail in mails:
            parts = [p for p in re.split(r"[._\-]+", re.split(r"[@＠(\[ ]", mail)[0]) if len(p) > 1 and p.isalpha()]
            if len(parts) == 2:
                for m in re.finditer(rf"(?<!\w)(?:{re.escape(parts[0])}\s{re.escape(parts[1])}|{re.escape(parts[1])},\s{re.escape(parts[0])})(?![\w@])", text, re.I):
                    if all(w[:1].isupper() for w in m[0].split()):
                        found.append(m.span())
        return found


#: Words that are no surname though they follow a given name or a phrase.
# Words that begin a capitalised phrase before a verb without being a given name.
_NO_GIVEN = frozenset("The This That These Those A An Our Your My His Her Its We They It No New Old Order Ticket Team Carrier Support Customer Service Der Die Das Le La Les El Los Il Lo Gli O Os De Het Den Det".split())
_NO_NAME = re.compile(r"\b(?:" + _EN + r"|Inc|Ltd|GmbH|SARL|S\.A|Partners|AG|BV|AB|Street)\b")


_ANY_DIGIT, _FIRM = re.compile(rf"[{_D}]"), re.compile(r"\s(?:Inc|Ltd|GmbH|SARL|S\.A|&)\b")


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each item from left to right; where items overlap, the earlier kind in the order below wins."""
    taken: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))

    mails, words = [], set(_WORDS.findall(text))
    if "@" in text or "＠" in text or "at)" in text or "at]" in text or " at " in text and " dot " in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email")
            mails.append(m[0])
    if _ANY_DIGIT.search(text):
        forms = [pattern for whole, ends, pattern in ADDRESSES if not whole.isdisjoint(words) or any(e in text for e in ends)]
        for a, b in sorted(m.span() for pattern in forms for m in pattern.finditer(text)):
            add(a, b, "address")
        for kind, pattern in (("id_number", ID_NUMBER), ("phone", PHONE)):
            for m in pattern.finditer(text):
                if not _NOT_ID.search(text[max(0, m.start() - 30) : m.start()]):
                    add(*m.span(), kind)
    for a, b in names.by_given(text, words):
        if not _NO_NAME.search(text, a, b) and not _FIRM.match(text, b):
            add(a, b, "name")
    for a, b in names.by_context(text, mails):
        if not _NO_NAME.search(text, a, b):
            add(a, b, "name")
    return sorted(taken)


def canonical(kind: str, text: str) -> str:
    """One form for all spellings of an entity, so that they get one surrogate."""
    folded = " ".join(text.casefold().translate(str.maketrans("０１２３４５６７８９－＋＠", "0123456789-+@")).split())
    if kind == "name":
        last, comma, first = folded.partition(", ")
        return f"{first} {last}" if comma else folded
    if kind in ("phone", "id_number"):
        return re.sub(r"[^0-9a-z]", "", folded.replace("(0)", ""))
    if kind == "email":
        return re.sub(r"\s*[(\[]?\b(at|dot)\b[)\]]?\s*", lambda m: "@" if m[1] == "at" else ".", folded).replace(" ", "")
    return folded


# Syllables of surrogate names and streets.
_HEADS, _TAILS = "Ba Ce Di Fo Ga He Ju Ka Lo Mi Ne Po Ri Su Ta Vo".split(), "bel dan fir gor len mas nor pek ras sil tor vin wal zed kim lud".split()
_HOST_PART = re.compile(r"(@|＠| @ | ＠ | ?\(at\) ?| ?\[at\] ?| at )(.*)", re.S)
_CAPITALISED = re.compile(rf"[{_UP}]{_L}+")
# Endings of street names, kept in surrogates.
_STREET_END = re.compile("(straße|strasse|str|gasse|weg|allee|platz|straat|laan|gracht|gatan|vägen)$", re.I)
# Words of addresses that are no names and stay.
_KEPT = frozenset(
    f"{_EN} Flat Apt Unit rue av avenue chemin boulevard bd place allée bis ter des de du la le les Calle Avda Avenida Av Plaza Paseo Via Viale Piazza Corso V Rua R Travessa da do di del della C in".replace("|", " ").casefold().split()
)


def _digit(ch: str, shift: int, low: int = 0) -> str:
    """Another digit of the same width; not below ``low``."""
    base = ord("０") if ch >= "０" else ord("0")
    return chr(base + low + (ord(ch) - base + shift) % (10 - low))


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0, female: frozenset[str] = frozenset(w.casefold() for w in GIVEN_F.split())) -> str:
    """A replacement of the same kind and form, from a keyed hash of the canonical form and the number of the attempt.

    Numbers keep their layout, the width of their digits and leading zeros; addresses their words, layout and postal
    code; e-mail addresses the way they are written; names the gender of their given name, the order and the letter case.
    """
    digest = hmac.new(key, f"{kind}|{canonical(kind, text)}|{attempt}".encode(), hashlib.blake2b).digest()
    made = lambda k: _HEADS[digest[k % 61] % 16] + _TAILS[digest[(k + 1) % 61] % 16] + _TAILS[digest[(k + 2) % 61] % 16]
    more = "".join(_TAILS[digest[10 + k % 54] % 16] for k in range(2 * attempt))  # each attempt has more values than the one before
    if kind in ("phone", "id_number"):
        out, k = [], 0
        for ch in text:
            if ch.isdigit():
                k += 1
                ch = ch if ch in "0０" and k == 1 else _digit(ch, digest[k % 64] + k)
            elif ch.isalpha():
                k += 1
                ch = chr((65 if ch.isupper() else 97) + digest[k % 64] % 26)
            out.append(ch)
        return "".join(out)
    if kind == "email":
        host = _HOST_PART.search(text)
        local = f"{made(0)}.{made(3)}{more}{digest[9]}".lower()
        dot = next((d for d in (" [dot] ", "[dot]", " (dot) ", "(dot)", " dot ") if d in text), ".")
        plain = f"{local}{host[1] if host else '@'}example{dot}org"
        return plain.upper() if text.isupper() else plain
    if kind == "address":
        count = iter(range(1, 10_000))
        word = lambda m: _street(m[0], made(3 * next(count)))
        out = _CAPITALISED.sub(word, text)
        cut = out.find(" ")
        out = re.sub(r"[0-9]+", lambda m: "".join(_digit(c, digest[next(count) % 64], int(i == 0 and c != "0")) for i, c in enumerate(m[0])), out)
        return out if not more else out[:cut] + (more if out[cut - 1 : cut].isalpha() else " " + more.capitalize()) + out[cut:]
    canon = canonical(kind, text)
    pool = GIVEN_F.split() if canon.split(" ")[0] in female else GIVEN_M.split()
    first, last = pool[digest[0] % len(pool)], f"{made(1)}{_TAILS[digest[4] % 16]}{more}"
    comma = re.search(r",\s", text)
    name = f"{last}{comma[0]}{first}" if comma else f"{first} {last}"
    return name.upper() if text.isupper() else name.lower() if text.islower() else name


def _street(word: str, other: str) -> str:
    """A capitalised word of an address in another wording, with the ending of its kind of street and its case."""
    if word.casefold() in _KEPT:
        return word
    end = _STREET_END.search(word)
    out = other + end[0].lower() if end and end.start() > 0 else other
    return out.upper() if word.isupper() else out


ENTITIES = "array<struct<kind:string,start:int,end:int,text:string,entity:string,surrogate:string>>"


def detect(df: DataFrame, text_col: str, key: bytes = b"decidra", given: tuple[str, ...] = (), out_col: str = "entities") -> DataFrame:
    """Adds the personal information of each text: kind, range (half-open, from 0), spelling, canonical form, surrogate.

    Null texts give null, texts without any an empty array; texts are read whole, repeated rows stay repeated, an existing
    ``out_col`` is replaced, and all other columns are kept. ``given`` adds given names to the built-in ones.
    """
    names = Names([*GIVEN_F.split(), *GIVEN_M.split(), *given])

    @F.arrow_udf(ENTITIES)  # type: ignore[attr-defined]
    def run(texts: pa.Array) -> pa.Array:
        rows, offsets, missing = [], [0], []
        for t in texts.to_pylist():
            if t is not None:
                rows += [(k, a, b, t[a:b], canonical(k, t[a:b]), surrogate(k, t[a:b], key)) for a, b, k in find(t, names)]
            offsets.append(len(rows))
            missing.append(t is None)
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        each = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["kind", "start", "end", "text", "entity", "surrogate"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each, mask=pa.array(missing))

    return df.withColumn(out_col, run(F.col(f"`{text_col}`")))


def distinct_surrogates(found: DataFrame, key: bytes = b"decidra", out_col: str = "entities", rounds: int = 8) -> DataFrame:
    """The collision check: (kind, entity, surrogate, attempt) of all entities, with surrogates distinct between entities.

    Entities of which two have one surrogate are few; all but the first by canonical form are hashed again, with the
    number of the attempt, until none collide; names, e-mail and street addresses grow with it. What still collides after
    ``rounds`` raises an error: numbers keep their layout, which may have fewer values than entities. Only (kind, entity) pairs are shuffled, grouped before they are compared.
    """
    flat = found.select(F.explode(F.col(f"`{out_col}`")).alias("e"))
    kept = flat.groupBy(F.col("e.kind").alias("kind"), F.col("e.entity").alias("entity")).agg(F.min("e.text").alias("text"), F.min("e.surrogate").alias("surrogate"), F.lit(0).alias("attempt"))

    def again(attempt: int):
        @F.pandas_udf("string")  # type: ignore[call-overload]
        def run(kind: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, t, key, attempt) for k, t in zip(kind, text)], dtype=object)

        return run

    kept = cut_lineage(kept)
    for attempt in range(1, rounds + 1):
        first = kept.groupBy("kind", F.lower("surrogate").alias("s")).agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1")
        if first.isEmpty():
            break
        if attempt == rounds:
            raise ValueError(f"surrogates that still collide after {rounds} rounds: {first.limit(5).collect()}")
        clash = kept.alias("k").join(first.alias("f"), (F.col("k.kind") == F.col("f.kind")) & (F.lower("k.surrogate") == F.col("f.s")) & (F.col("k.entity") > F.col("f.first")), "left")
        kept = cut_lineage(clash.select("k.kind", "k.entity", "k.text", F.when(F.col("f.s").isNotNull(), again(attempt)(F.col("k.kind"), F.col("k.text"))).otherwise(F.col("k.surrogate")).alias("surrogate"), F.when(F.col("f.s").isNotNull(), attempt).otherwise(F.col("k.attempt")).alias("attempt")))
    return kept.drop("text")


def checked(df: DataFrame, id_col: str, text_col: str, key: bytes = b"decidra", given: tuple[str, ...] = ()) -> DataFrame:
    """(id, kind, start, end, text, entity, surrogate): every entity of every text, with surrogates that passed the check.

    ``id_col`` tells the texts apart; rows whose text is null or holds nothing give no row. Detection runs once: its rows
    are kept by a checkpoint, grouped by (kind, entity) for the check, and joined with what the check gives.
    """
    once = detect(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("_t")), "_t", key, given, "_e")
    flat = cut_lineage(once.select("id", F.explode("_e").alias("e")).select("id", "e.*"))
    kept = distinct_surrogates(flat.select(F.array(F.struct("kind", "start", "end", "text", "entity", "surrogate")).alias("entities")), key)

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def spelled(kind: pd.Series, text: pd.Series, own: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, t, key, int(n)) if n else o for k, t, o, n in zip(kind, text, own, attempt)], dtype=object)

    both = flat.join(kept.select("kind", "entity", "attempt"), ["kind", "entity"])  # each spelling in its own order and case
    return both.select("id", "kind", "start", "end", "text", "entity", spelled("kind", "text", "surrogate", "attempt").alias("surrogate"))


def with_surrogates(df: DataFrame, id_col: str, text_col: str, key: bytes = b"decidra", out_col: str = "redacted") -> DataFrame:
    """Adds the text with each entity replaced by its checked surrogate. Ids must be unique; null texts stay null."""
    entities = checked(df, id_col, text_col, key).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "text", "entity", "surrogate"))).alias("_e"))
    rows = df.join(entities.withColumnRenamed("id", id_col), id_col, "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,text:string,entity:string,surrogate:string>>)")
    return redact(rows.withColumn("_e", F.coalesce("_e", none)), text_col, "_e", out_col, surrogates=True).drop("_e")


def redact(found: DataFrame, text_col: str, entities_col: str = "entities", out_col: str = "redacted", surrogates: bool = False, key: str = "decidra") -> DataFrame:
    """Adds the text with each entity replaced by its typed placeholder ``[KIND_code]`` or by its surrogate; all else is unchanged.

    The placeholder's code is a SHA-256 of the key and the canonical form: one entity has one code everywhere, different
    ones never share it in practice, and without the key none can be guessed. The surrogates are those of
    ``entities_col``, as ``with_surrogates`` has checked them. Null texts stay null.
    """
    text, entities = F.col(f"`{text_col}`"), F.col(f"`{entities_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, e):
        mark = e["surrogate"] if surrogates else F.concat(F.lit("["), F.upper(e["kind"]), F.lit("_"), F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), e["kind"], e["entity"]), 256)), 256), F.lit("]"))
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), mark).alias("out"), e["end"].alias("at"))

    whole = F.aggregate(entities, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(out_col, whole)
