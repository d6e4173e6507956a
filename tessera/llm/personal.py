"""Personal information inside free text, by aggregated weak supervision (problem 10)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.skew import skew_join
from tessera.session import staged

KINDS = ("email", "id_number", "phone", "street_address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "street_address": "[ADDRESS]", "name": "[NAME]"}

#: Widespread given names of several languages, the seed of the gazetteer; all others are harvested from the texts.
GIVEN = """adam ahmed alan alexander alfred ali alice amelia amina amy ana andrea andreas andrew angela anita anna anne anthony antonio arthur barbara beatrice
benjamin bernard brian bruno camille carla carlos carmen caroline catherine charles charlotte chen christian christine claire clara claudia daniel david
deborah diana diego dmitri dorothy edward elena elizabeth ella emil emily emma eric erik ernst eva fatima felix fernando francis francois frank fatou
gabriel george giovanni giulia grace greta guillaume hannah hans harold hassan heinrich helen henri henry hiroshi hugo ibrahim ines ingrid irene isabel
ivan jack jacob jacques jakob james jan jane javier jean jennifer jessica joan john jonas jose joseph juan julia julie julian kamala karen karl katherine keiko
kenji kevin klaus kumar laura lars lena leon li linda lisa louis louise lucas lucia luis luca lydia mahmoud marco margaret maria marie mario mark marta
martin mary matthew max mei michael michel miguel mohamed nadia natalia nicolas nina olga oliver olivia omar oskar otto pablo patricia patrick paul paula pedro
peter pierre priya rachel ravi rebecca richard robert rosa ruth samuel sandra sara sarah simon sofia sophie stefan susan tariq thomas tomas ursula
vera victor viktor walter wei werner william wolfgang yusuf yuki""".split()
#: Words for places, buildings and organisations in four languages; a name that holds one, or is followed by one, is the name of a thing.
THINGS = """academy agency airport arms association authority avenue award bank bay beach board boulevard bridge building canal castle cathedral centre center chapel
church city clinic close club college committee company corporation council county court creek cup dam department district dock drive estate factory ferry festival field
forest fort foundation fountain gallery garden gardens gate group guild hall harbour herald hill hospital hotel house inn institute island journal lake lane
library lighthouse lock lodge market memorial ministry monument mountain museum observatory office orchestra park party path peak pier place plaza point press prize quarry quay
railway range region reservoir river road school society square stadium station street survey theatre times tower trust tunnel union university valley viaduct
village way wharf woods yard allee brücke gasse gesellschaft kapelle kirche museum platz schule straße verein weg chapelle école église mairie place pont rue calle
escuela iglesia plaza puente""".split()
_THINGS = frozenset(THINGS)
#: Ends of common nouns in the same languages, which no surname is expected to have.
_NOUN = re.compile(r"(?:arium|orium|eum|tion|sion|ment|ness|ship|ology|graphy|ment|ität|ungen|heit|keit|schaft|ausweis|nummer|ción|dad|tés?)$")
_TITLES = frozenset("prof professor dr doctor mr mrs ms miss mx herr frau mme mlle m sr sra srta don doña sir dame lady lord rev".split())
#: Words that may stand before a name with a capital at the start of a sentence.
_FUNCTION = frozenset("""the a an and or but when while after before since in on at by for from to with as if then this that his her their our my der die das ein eine und oder als
tel tél fax phone mobile email mail id passport isbn nach mit von bei zu im am le la les un une et ou par avec pour chez el los las un una y o con por para de según""".split())
_PARTICLES = "van der|van den|von der|de la|de los|de las|van|von|de|del|della|der|den|di|da|dos|du|la|le|ter|ten|zu|bin|al"
_PARTICLE_WORDS = frozenset(w for p in _PARTICLES.split("|") for w in p.split())

_RANGE = [*range(0x41, 0x530), *range(0x1E00, 0x2000)]
_U = "".join(c for c in map(chr, _RANGE) if unicodedata.category(c) in ("Lu", "Lt"))
_L = "".join(c for c in map(chr, _RANGE) if unicodedata.category(c) == "Ll") + "̀-ͯ"
_W = _U + _L
_CAP = rf"(?:[{_U}]['’])?[{_U}][{_L}]+(?:[{_U}][{_L}]+)?"
_CHAIN = rf"{_CAP}(?:-{_CAP})*"
_UP = rf"[{_U}][{_U}'’]+(?:-[{_U}][{_U}'’]+)*"
_INI = rf"[{_U}]\.(?!\w)"
_STEP = rf"(?: |(?<=\.) ?)(?:(?:{_PARTICLES}) )*"
# Patterns that are searched for begin with a set of characters, which is found quickly; what stands before it is looked at next.
_FIRST = rf"[{_U}](?<![{_W}\d'’].)"
_REST = rf"(?:['’][{_U}])?[{_L}]+(?:[{_U}][{_L}]+)?(?:-{_CAP})*"
#: Runs of capitalised words, initials and particles, in small letters with a capital, or in capitals.
_RUN = re.compile(rf"{_FIRST}(?:{_REST}|\.(?!\w))(?:{_STEP}(?:{_CHAIN}|{_INI}))+(?![{_W}])")
_UP_RUN = re.compile(rf"{_FIRST}[{_U}'’]+(?:-[{_U}][{_U}'’]+)*(?: (?:(?:{_PARTICLES.upper()}) )*(?:{_UP}|{_INI}))+(?![{_W}])")
#: Surname first, as written and in capitals; particles before it are looked for separately.
_SWAP = re.compile(rf"(?P<s>[{_U}](?<![{_W}\d'’-].){_REST})(?=, (?P<g>{_CHAIN})(?![{_W}]))")
_UP_SWAP = re.compile(rf"(?P<s>[{_U}](?<![{_W}\d'’-].)[{_U}'’]+(?:-[{_U}][{_U}'’]+)*)(?=, (?P<g>{_UP})(?![{_W}]))")
_PARTICLES_BEFORE = re.compile(rf"(?<![{_W}\d'’-])(?:(?:{_PARTICLES}) )+$")
_UP_PARTICLES_BEFORE = re.compile(rf"(?<![{_W}\d'’-])(?:(?:{_PARTICLES.upper()}) )+$")
_CAPITAL_BEFORE = re.compile(rf"(?<![{_W}])([{_U}][{_W}'’-]*) $")
_TOKEN = re.compile(rf"[{_U}]\.|[{_W}'’]+(?:-[{_W}'’]+)*")
_LOW_WORD = re.compile(rf"[{_L}]{{2,}}")
_LOW_GIVEN = re.compile(rf"[{_L}](?<![{_W}\d@._'’-].)[{_L}]+(?:-[{_L}]{{2,}})?")
_LOW_REST = re.compile(rf"(?: [{_L}]\.)* ((?:(?:{_PARTICLES}) )*[{_L}]['’]?[{_L}]{{3,}}(?:-[{_L}]{{3,}})*)(?![{_W}@+]|\.[{_W}])")
_LOW_SURNAME = re.compile(rf"(?:(?<![{_W}\d@._'’-])(?:{_PARTICLES}) )*(?<![{_W}\d@._'’-])[{_L}]['’]?[{_L}]{{3,}}(?:-[{_L}]{{3,}})*, $")
_MORE_INITIALS = re.compile(rf"(?: [{_U}]\.)+(?!\w)", re.I)

#: Cues of four languages by class: what a person is called by, what a person does, how one is introduced.
ROLES_BEFORE = frozenset("""by with from named called signed sincerely regards name nom nombre author autor auteur editor owner holder contact kontakt contacto informant entretien entrevista
portrait text texte texto drawing von par avec por con""".split())
_ROLE_STARTS = ("interview", "photo", "foto")
#: Ends of words for what a person does.
_ROLE_ENDS = ("er", "or", "ist", "ian", "ant", "man", "woman")
#: Two words that introduce a name, and words that may stand between a role and a name.
_PAIRS = frozenset(("ask for", "family of", "son of", "daughter of", "wife of", "husband of"))
_LINKS = frozenset("by of von de with avec con".split())
_DOES = re.compile(
    r",? (?:lives?|lived|resides?|resided|works?|worked|was born|were married|is survived|died|said|says|wrote|writes|told|asked|answers?|answered|signed|owns?|owned|teaches|taught|joined|retired|moved|(?:may|can|could|should|must|will) be (?:reached|contacted|called|found)|"
    r"is (?:a|an|the|my|his|her|our|now|responsible|available)\b|born|aged|wohnt|wohnte|wohnhaft|lebt|arbeitet|sagte|geboren|schrieb|habite|habitait|demeure|née?|travaille|est né|a dit|vive|vivía|reside|nació|trabaja|dijo|firmó)\b", re.I)
_FIELD_BEFORE = re.compile(r"(?:^|\n)[*#:;|!-]+ ?$|\|\| ?$|\|[^|=\n{}\[\]]{1,30}= ?$|<!-- ?$|\[\[[^|\]\n]+\|$|(?:^|\n)$|: ?$|-- ?$")
_FIELD_AFTER = re.compile(r" ?\|\|| ?(?:\n|$)|\]\]| ?-->|, ?[\d(+]| ?[(<]|[.!]+(?:\s|$)")
_SAINT = re.compile(r"(?:\b(?:Saint|Sainte|St|Ste|San|Santa|Santo|Sankt|São)\.?[ -]|\[\[(?:[A-Z][a-z]+:)[^|\]\n]*)$", re.I)
_NAMED_AFTER = re.compile(r" (?:was|is|were) (?:named|built|opened|rebuilt|restored|drained|closed|located)|, opened")

_AT = r"(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| AT )"
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?| DOT )"
_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])|(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]* at [A-Za-z0-9-]+ dot [A-Za-z]{{2,}}\b")
_BEFORE_EMAIL = re.compile(r"(?:e-?mails?|mail|mailto|courriel|correo|write|schreib\w*|écri\w*|escrib\w*|contact\w*|kontakt\w*|reply\w*|address|adresse|dirección|\bor|\bto|\ban|\bà|\ba)[ :=]*$", re.I)

#: Written forms of telephone numbers: international with + or 00, area code in brackets, and national groups.
_PHONE = re.compile(
    r"(?<![\w+.,/=-])(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,10}){1,5}|00\d{1,3}(?:[ .-]\d{2,8}){2,4}|(?:\d{1,2}[ .-])?\(\d{2,5}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}([ .-])\d{3}\1\d{4}|0\d{2} \d{4} \d{4}|0\d{3,4} \d{3} ?\d{3,4}|0\d(?:[ .]\d\d){4}|0\d{2,4}[-/ ]\d{5,8})(?![\w]|[-.,]\d)")
_SURE_PHONE = re.compile(r"\+|00|\(")
_BEFORE_PHONE = re.compile(r"(?:tel\w*|tél\w*|phone|handy|móvil|mobile|cell|fax|voice|call|ring|dial|number|under|unter|reach\w* (?:at|on|under)|answers (?:on|to|at)|contact\w*|kontakt\w*)[ .:,=/]*$", re.I)
_NOT_PERSONAL = re.compile(r"(?:isbn|issn|grid|coord\w*|catalog\w*|no\.|n°|nr\.|núm\.|year|pages?|census|height of|dates?|doi|oclc|lot|part|item|version|serial|model|invoice|order|population|area\w*|elevation\w*)[ =:|.,#_-]*(?:no|nr|number)?[ =:|.,#-]*(?:[\d.,-]+[ ,|-]*)?$", re.I)

_ID = re.compile(
    r"[A-Z\d](?<![\w.,/+-].)(?:(?<=\d)(?:\d{2}-\d{2}-\d{4}|\d{7}[A-Z]|\d{5}[-+]\d{4}|\d \d{3} \d{3} \d{3}|\d{6,11})|(?<=[A-Z])(?:\d{8}|[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]?\d{6,9}[A-Z]?)|(?<=[XYZ])-?\d{7}-?[A-Z])(?![\w]|[-.,]\d)")
_BEFORE_ID = re.compile(
    r"(?:passports?|pasaporte|reisepass|passeport|SSN|ID|\w*ID-?card|identity(?: card| document)?|insurance|NINO|social security|personal|personnummer|personalausweis|ausweis|steuer-?id|sozialversicherung\w*|numéro national|sécurité sociale|"
    r"identité|DNI|NIF|NIE|CURP|driver'?s licen[cs]e|driving licen[cs]e|tax|patient|employee|student)(?: ?-?(?:no|nr|number|numbers|nummer|n[°º]|n\.?º|id|code|card)\.?)?(?: is| was| ist| est| es)?[ =:.#]*$", re.I)

_NUM = r"\d{1,4}[a-zA-Z]?"
_TYPE = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Cl|Drive|Dr|Place|Pl|Square|Sq|Terrace|Way|Crescent|Cres|Row|Walk|Gardens|Gdns|Boulevard|Blvd|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|COURT|CT|CLOSE|DRIVE|PLACE|SQUARE)"
_END = rf"(?:\.(?=\.|,|;| ?\)| [{_L}]))?"
_STREET = re.compile(
    rf"(?<![\w.,/-])(?:{_NUM} (?:[{_U}][{_W}'’-]+ ){{1,3}}{_TYPE}(?![{_W}]){_END}"
    rf"|{_NUM},? (?:rue|avenue|av\.|bd|boulevard|chemin|place|allée|impasse|quai|route|cours|square)(?: (?:de la|de l'|des|du|de|d'))? ?(?<=[ '])[{_U}][{_W}'’-]+"
    rf"|(?:(?:Am|An der|Auf der|Im|In der|Zum|Zur|Alte|Alter) )?[{_U}][{_W}-]*(?:straße|strasse|str\.|allee|weg|platz|gasse|ring|damm|ufer|markt|chaussee),? {_NUM}(?![\w])"
    rf"|(?:[Cc]alle|[Cc]/|[Aa]venida|[Aa]vda?\.|[Pp]laza|[Pp]l\.|[Pp]aseo|[Cc]amino|[Cc]arrera|[Rr]onda)(?: (?:de la|de los|de las|del|de))? [{_U}][{_W}'’-]+,? (?:n\.?º ?)?{_NUM}(?![\w]))")
_BEFORE_STREET = re.compile(r"(?:\b(?:at|to|in|from|near|address|adresse|dirección|lives?|resides?|wohnhaft|wohnt|habite|demeure|vive|reside)|\b(?:flat|apt\.?|apartment|wohnung|piso|unit) \w+,|,)[ :=]*(?:en |à |au |in der )?$", re.I)
_AFTER_STREET = re.compile(rf"[.]?(?:,? (?:in |à |en |\d{{4,5}} )?[{_U}]| ?\(|\.|;|$|\n)")

#: Quick searches for places where a full pattern is then tried.
_SIGN = re.compile(r"@")
_SPELT_SIGN = re.compile(r"[\[({] ?at ?[\])}]")
_WORD_SIGN = re.compile(r" AT | at (?=[\w-]+ dot )")
_DIGITS = re.compile(r"[+(\d](?:(?<=[+(])(?=\d)|(?<=\d)(?<!\d.)(?=\d{0,4}[ ./()-]+\d))")
_HOUSE = re.compile(rf"\d(?<!\w.)\d{{0,3}}[a-zA-Z]?,? (?=[{_W}])")
_GERMAN = re.compile(r"(?:straße|strasse|str\.|allee|weg|platz|gasse|ring|damm|ufer|markt|chaussee),? \d")
_SPANISH = re.compile(r"\b(?:calle|c/|avenida|avda?\.|plaza|pl\.|paseo|camino|carrera|ronda) ", re.I)
#: Small-letter texts one of which every Spanish street has; a text without them is not searched for one.
_SPANISH_PARTS = ("calle ", "c/ ", "avenida ", "avda", "avd.", "av.", "plaza ", "pl. ", "paseo ", "camino ", "carrera ", "ronda ")
#: Characters between a name and other personal information that count as beside it.
NEAR = 40


def _windows(places, before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Merged stretches around the places."""
    out: list[list[int]] = []
    for a in places:
        x, y = max(0, a - before), min(size, a + after)
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _matches(kind: str, text: str):
    """All matches of a kind's pattern but names; the quick searches find every place the pattern can match."""
    n = len(text)
    if kind == "id_number":
        yield from _ID.finditer(text)
    elif kind == "email":
        places = [m.start() for m in _SIGN.finditer(text)] + [m.start() for m in _SPELT_SIGN.finditer(text)]
        if " AT " in text or " dot " in text:
            places += [m.start() for m in _WORD_SIGN.finditer(text)]
        for x, y in _windows(sorted(places), 80, 100, n):
            yield from _EMAIL.finditer(text, x, y)
    elif kind == "phone":
        end = 0
        for place in _DIGITS.finditer(text):
            if place.start() >= end and (m := _PHONE.match(text, place.start())):
                end = m.end()
                yield m
    else:
        for place in _HOUSE.finditer(text):
            if m := _STREET.match(text, place.start()):
                yield m
        low = text.lower()
        spanish = [m.start() for m in _SPANISH.finditer(text)] if any(p in low for p in _SPANISH_PARTS) else []
        for x, y in _windows(sorted([m.start() for m in _GERMAN.finditer(text)] + spanish), 45, 60, n):
            yield from _STREET.finditer(text, x, y)


def valid_isbn(digits: str) -> bool:
    """Whether 10 or 13 digits carry the check digit of a book number."""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(digits)) % 10 == 0
    return len(digits) == 10 and sum(int(c) * (10 - i) for i, c in enumerate(digits)) % 11 == 0


def votes_of(kind: str, text: str, a: int, b: int) -> list[int]:
    """The votes of the labelers of all kinds but names: form, validity, context before, context after; 1 for, -1 against, 0 no opinion."""
    before, after, found = text[max(0, a - 60) : a], text[b : b + 40], text[a:b]
    if kind == "email":
        return [1, 1 if "@" in found and " " not in found else 0, 1 if _BEFORE_EMAIL.search(before) else 0, -1 if before.endswith(("{{", '"')) else 0]
    cue = _NOT_PERSONAL.search(before)
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        sure = 1 if _SURE_PHONE.match(found) else 0
        return [sure, 1 if _BEFORE_PHONE.search(before) else 0, -1 if cue else 1, 1 if 9 <= len(digits) <= 15 else -1, -1 if not sure and valid_isbn(digits) else 0]
    if kind == "id_number":
        named = bool(_BEFORE_ID.search(before))
        return [1 if named else -1, -1 if not named and cue else 0, 1 if re.match(r"[,;.)]| and |$|\s", after) else 0, -1 if re.fullmatch(r"\d{7,12}", found) and not named else 0]
    year = re.match(r"1[3-9]\d\d|20\d\d", found)
    return [1, 1 if _BEFORE_STREET.search(before) else 0, 1 if _AFTER_STREET.match(after) else 0, -1 if year else 0, -1 if _NAMED_AFTER.match(after) else 0]


# A name candidate: start, stop, form, given names, surnames, the run it is in (start, stop). Forms: 0 as written, 1 initials, 2 surname first, 3 and 4 the
# first and third in capitals, 5 and 6 in small letters.
def _pieces(token: str) -> list[str]:
    return [p for p in token.lower().split("-") if p]


def _in_run(text: str, m, upper: bool):
    """Candidates of one run: a given name or initials, further initials, particles, a surname."""
    tokens = [(t.start() + m.start(), t.end() + m.start(), t.group()) for t in _TOKEN.finditer(m.group())]
    kinds = ["i" if t[2].endswith(".") else "p" if t[2].lower() in _PARTICLE_WORDS and (upper or t[2][0].islower()) else "t" if t[2].lower() in _TITLES else "w" for t in tokens]
    for i, kind in enumerate(kinds):
        if kind not in "wi" or kind == "i" and i and kinds[i - 1] in "iw":
            continue
        j = i + 1
        while j < len(tokens) and kinds[j] == "i":
            j += 1
        while j < len(tokens) and kinds[j] == "p":
            j += 1
        if j < len(tokens) and kinds[j] == "w":
            left = i - 1
            while left >= 0 and kinds[left] == "t":
                left -= 1
            part = left >= 0 and not (left == 0 and tokens[0][2].lower() in _FUNCTION) or j + 1 < len(tokens) and kinds[j + 1] != "t"
            yield tokens[i][0], tokens[j][1], (3 if upper else 0) if kind == "w" else 1, _pieces(tokens[i][2]) if kind == "w" else [], _pieces(tokens[j][2]), part


def name_candidates(text: str, given: frozenset):
    """All candidates of names in their forms; those in small letters need a given name of the gazetteer to be found at all."""
    for upper, run, swap, particles in ((False, _RUN, _SWAP, _PARTICLES_BEFORE), (True, _UP_RUN, _UP_SWAP, _UP_PARTICLES_BEFORE)):
        for m in run.finditer(text):
            yield from _in_run(text, m, upper)
        for m in swap.finditer(text):
            start, stop = m.start(), m.end("g")
            if p := particles.search(text[max(0, start - 24) : start]):
                start -= len(p.group())
            more = _MORE_INITIALS.match(text, stop)
            before = _CAPITAL_BEFORE.search(text[max(0, start - 30) : start])
            part = before is not None and before.group(1).lower() not in _FUNCTION and before.group(1).lower() not in _TITLES
            yield start, more.end() if more else stop, 4 if upper else 2, _pieces(m.group("g")), _pieces(m.group("s")), part
    if not given.isdisjoint(_LOW_WORD.findall(text)):
        for m in _LOW_GIVEN.finditer(text):
            parts = _pieces(m.group())
            if given.isdisjoint(parts):
                continue
            if rest := _LOW_REST.match(text, m.end()):
                yield m.start(), rest.end(), 5, parts, _pieces(rest.group(1).split(" ")[-1]), False
            if s := _LOW_SURNAME.search(text[max(0, m.start() - 60) : m.start()]):
                start = max(0, m.start() - 60) + s.start()
                more = _MORE_INITIALS.match(text, m.end())
                yield start, more.end() if more else m.end(), 6, parts, _pieces(s.group()[:-2].split(" ")[-1]), False


#: Marks that may stand at the start of a word.
_OPENING = "([{|*'\"„“‘«<>-–—:;,!."


def _titled(before: str) -> int:
    """Characters of a title and its blank at the end of the text before a name; 0 if there is none."""
    if not before.endswith(" "):
        return 0
    parts = before.split()
    word = parts[-1].lstrip(_OPENING) if parts else ""
    low = word.lower().rstrip(".")
    if low not in _TITLES or not (word[0].isupper() or low in ("don", "doña")) or low == "m" and (word != "M." or len(parts) > 1 and parts[-2].isdigit()):
        return 0
    return len(word) + 1


def _role(before: str) -> bool:
    """Whether the text before a name ends with what introduces a person, or with what a person does."""
    tail = before.rstrip(" ,:=")
    if len(tail) == len(before) or tail.endswith((".", "!", "?", ";")):
        return False
    words = [w.strip(_OPENING + "]") for w in tail[-32:].lower().split()[-2:]]
    if not words:
        return False
    if words[-1] in ROLES_BEFORE or " ".join(words) in _PAIRS:
        return True
    word = words[-2] if words[-1] in _LINKS and len(words) > 1 else words[-1]
    return word in ROLES_BEFORE or word.startswith(_ROLE_STARTS) or len(word) >= 5 and word.endswith(_ROLE_ENDS)


def _context(text: str, a: int, b: int, starts: list[int], stops: list[int]) -> tuple[int, int, int, int]:
    """Evidence around a name: title, role word before, what a person does after, other personal information on the same line."""
    before, after = text[max(0, a - 40) : a], text[b : b + 40]
    titled = _titled(before)
    if titled:
        before = before[:-titled]
    near = 0
    i = bisect_left(starts, b)
    if i < len(starts) and starts[i] - b <= NEAR and "\n\n" not in text[b : starts[i]]:
        near = 1
    i = bisect_right(stops, a) - 1
    if not near and i >= 0 and a - stops[i] <= NEAR and "\n\n" not in text[stops[i] : a]:
        near = 1
    return 1 if titled else 0, 1 if _role(before) else 0, 1 if _DOES.match(after) else 0, near


def name_votes(text: str, c: tuple, given: frozenset, surnames: frozenset, things: frozenset, starts: list[int], stops: list[int]) -> list[int] | None:
    """The votes of the labelers of names; None where none is for it.

    Gazetteers of given names and surnames (no opinion on what a word for a thing belongs to), title, role word before, what a person does after, other personal information
    beside it, a field or list item of its own; against it: words for things, saints, parts of longer runs, odd writing.
    """
    a, b, form, g, s, part = c
    after = text[b : b + 24]
    follow = re.match(rf" ([{_W}]+)", after)
    thing = not _THINGS.isdisjoint(g) or not _THINGS.isdisjoint(s) or any(_NOUN.search(w) for w in (*g, *s)) or follow is not None and follow.group(1).lower() in _THINGS and follow.group(1)[0].isupper()
    by_name = 0 if thing or given.isdisjoint(g) else 1, 0 if thing or surnames.isdisjoint(s) else 1
    around = _context(text, a, b, starts, stops)
    if not any(by_name) and not any(around):
        return None
    before = text[max(0, a - 40) : a]
    field = 1 if _FIELD_BEFORE.search(before) and _FIELD_AFTER.match(after) else 0
    head = 0 if things.isdisjoint(s) else -1
    odd = not _FUNCTION.isdisjoint(g) or not _FUNCTION.isdisjoint(s) or any(w in ROLES_BEFORE or w.startswith(_ROLE_STARTS) for w in g)
    return [*by_name, *around, field, -1 if thing else 0, -1 if _SAINT.search(before) else 0, -1 if part or odd else 0, head, -1 if form >= 2 else 0]


def candidates_of(text: str, given: frozenset, surnames: frozenset, things: frozenset = frozenset()) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, key) of all candidates with a vote for them; key: the form and the votes, as text.

    Of overlapping candidates of a kind the one with most votes stays, then the longest, then the first.
    """
    out, others = [], []
    for kind in KINDS:
        spans = []
        if kind != "name":
            for m in _matches(kind, text):
                votes = votes_of(kind, text, *m.span())
                spans.append((sum(votes), m.end() - m.start(), m.start(), m.end(), 0, votes))
        else:
            starts, stops = sorted(x[1] for x in others), sorted(x[2] for x in others)
            for c in name_candidates(text, given):
                if votes := name_votes(text, c, given, surnames, things, starts, stops):
                    spans.append((sum(votes), c[1] - c[0], c[0], c[1], c[2], votes))
        spans.sort(key=lambda s: (-s[0], -s[1], s[2]))
        taken_a: list[int] = []
        taken_b: list[int] = []
        for total, _, a, b, k, votes in spans:
            i = bisect_left(taken_b, a + 1)
            if i < len(taken_a) and taken_a[i] < b:
                continue
            taken_a.insert(i, a)
            taken_b.insert(i, b)
            row = (kind, a, b, f"{k}:" + ",".join(map(str, votes)))
            out.append(row)
            if kind != "name" and total > 0 and not (kind == "id_number" and votes[0] < 0):
                others.append(row)
    return out


def _harvest(batches):
    """(role, word, n): words of names in well cued places, and how often a word ends a capitalised pair after a given name or another word.

    Well cued is beside a known given name one cue, else two of different kinds, and nothing against it.
    """
    seed = frozenset(GIVEN)
    for batch in batches:
        rows: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            others = []
            for kind in KINDS[:-1]:
                for m in _matches(kind, text):
                    votes = votes_of(kind, text, *m.span())
                    if sum(votes) > 0 and not (kind == "id_number" and votes[0] < 0):
                        others.append(m.span())
            starts, stops = sorted(x for x, _ in others), sorted(x for _, x in others)
            for c in name_candidates(text, frozenset()):
                if c[2] == 0:
                    after = "after given" if not seed.isdisjoint(c[3]) else "after other"
                    rows.update((after, w) for w in c[4])
                votes = name_votes(text, c, seed, frozenset(), frozenset(), starts, stops)
                if votes and c[3] and min(votes[7:10]) == 0 and sum(votes[:6]) >= 2 and (votes[0] or sum(votes[2:6]) >= 2):
                    rows.update(("given", w) for w in c[3])
                    rows.update(("surname", w) for w in c[4])
        if rows:
            roles, words = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(roles, pa.string()), pa.array(words, pa.string()), pa.array(rows.values(), pa.int64())], ["role", "word", "n"])


#: Names that are broadcast at most; with more, every text gets those of its own words by a join.
MAX_NAMES = 200_000


def gazetteer(documents: DataFrame, least: int = 3) -> DataFrame:
    """(word, role) over all texts, role given, surname or thing; given names also from the seed.

    A word is a given name or surname if it is seen at least ``least`` times in well cued places, as the one it is seen as
    more often. A word that ends two capitalised pairs or more is a surname if half of them begin with a given name; one
    that ends five or more is the head of things' names if at most a twentieth do.
    """
    seen = documents.select("text").mapInArrow(_harvest, "role string, word string, n long").groupBy("word")
    of = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
    both = seen.agg(of("given").alias("g"), of("surname").alias("s"), of("after given").alias("ag"), of("after other").alias("ao"))
    pairs = F.col("ag") + F.col("ao")
    thing = (pairs >= 5) & (F.col("ag") <= 0.05 * pairs)
    cued = (F.col("s") >= least) & (F.col("s") > F.col("g"))
    role = F.when((F.col("g") >= least) & (F.col("g") > F.col("s")), "given").when(F.col("word").isin(*THINGS), None).when(cued, "surname").when(thing, "thing").when((pairs >= 2) & (F.col("ag") >= 0.5 * pairs), "surname")
    names = both.select("word", role.alias("role")).filter("role is not null")
    seed = documents.sparkSession.createDataFrame([(w, "given") for w in GIVEN], "word string, role string")
    return staged(names.unionByName(seed).distinct(), "gazetteer")


ROLES = ("given", "surname", "thing")


def _lookups(text: str) -> set[str]:
    """All small-letter words of a text that may be looked up in a gazetteer."""
    out = set()
    for run in set(re.findall(rf"[{_W}'’]+", text)):
        out.add(run.lower())
        out.update(p.lower() for p in re.split("['’]", run) if p)
    return out


def _with_names(documents: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, text, given, surnames, things): every row with the words of the gazetteer among its own, null where there are none."""

    def words(batches):
        for batch in batches:
            rows = [(i, w) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text for w in _lookups(text)]
            if rows:
                ids, found = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["row", "word"])

    rows = staged(documents.select(key, "text").withColumn("row", F.monotonically_increasing_id()), "texts")
    looked_up = staged(rows.select("row", "text").mapInArrow(words, "row long, word string"), "text-words")
    lists = [F.collect_set(F.when(F.col("role") == role, F.col("word"))).alias(name) for role, name in zip(ROLES, ("given", "surnames", "things"))]
    own = skew_join(looked_up, names, ["word"]).groupBy("row").agg(*lists)
    return rows.join(own, "row", "left").select(key, "text", "given", "surnames", "things")


#: Bounds of the log-odds of a vote for and of a vote against, by kind. Labelers that object to names are specific, so their votes weigh 12 to 1.
BOUNDS = {"name": ((0.3, 4.0), (-8.0, -2.5))}
_ANY = ((0.3, 30.0), (-30.0, -0.3))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50, needed: float = 0.0, trust: float = 0.02, bounds: tuple = _ANY) -> dict[tuple[int, ...], float]:
    """Posterior of being true for every vote pattern, by expectation-maximisation over the labelers' reliabilities.

    Labelers are taken as independent given the truth; each has a chance of every vote for true and for false spans.
    Starts from a majority of more than ``needed`` votes and keeps a weak prior that votes mean what they say. The weight of a
    vote stays within ``bounds``: no labeler is taken for worse than chance, and none decides alone, whatever it
    seems to be worth where votes depend on each other.
    """
    if not patterns:
        return {}
    keys = list(patterns)
    v, n = np.array(keys), np.array([patterns[k] for k in keys], float)
    score = v.sum(1)
    post = 1 / (1 + np.exp(-1.5 * (score - needed)))
    prior_for = {1: 4.0, 0: 3.0, -1: 1.0}
    for _ in range(rounds):
        logit = np.zeros(len(keys))
        w1, w0 = (n * post).sum() + 2, (n * (1 - post)).sum() + 2
        weak = trust * n.sum() + 1
        logit += np.log(w1) - np.log(w0)
        for j in range(v.shape[1]):
            for value in (1, 0, -1):
                at = v[:, j] == value
                p1 = ((n * post)[at].sum() + weak * prior_for[value] / 8) / (w1 - 2 + weak)
                p0 = ((n * (1 - post))[at].sum() + weak * prior_for[-value] / 8) / (w0 - 2 + weak)
                odds = np.log(p1) - np.log(p0)
                logit[at] += np.clip(odds, *bounds[0]) if value == 1 else np.clip(odds, *bounds[1]) if value == -1 else odds
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(keys, post.tolist()))


#: Forms of names, the features that are not votes.
_FORMS = 7


def span_classifier(counts: dict[str, int], rounds: int = 300, needed: float = 0.0, trust: float = 0.02, bounds: tuple = _ANY) -> dict[str, float]:
    """Probability of every candidate key of one kind: a logistic regression trained on the EM posteriors of all candidates.

    Features are the single votes by value and the form of the span; rows are weighted by their number.
    """
    if not counts:
        return {}
    split = {k: (int(k.split(":")[0]), tuple(map(int, k.split(":")[1].split(",")))) for k in counts}
    merged: dict[tuple[int, ...], int] = {}
    for k, n in counts.items():
        merged[split[k][1]] = merged.get(split[k][1], 0) + n
    post = reliabilities(merged, needed=needed, trust=trust, bounds=bounds)
    keys = list(counts)
    width = len(split[keys[0]][1])
    x = np.zeros((len(keys), 1 + 2 * width + _FORMS))
    for i, k in enumerate(keys):
        form, votes = split[k]
        x[i, 0] = 1
        for j, value in enumerate(votes):
            x[i, 1 + 2 * j] = value == 1
            x[i, 2 + 2 * j] = value == -1
        x[i, 1 + 2 * width + form] = 0.5
    y, n = np.array([post[split[k][1]] for k in keys]), np.array([counts[k] for k in keys], float)
    n = n / n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + 1e-4 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + (1e-4 + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


#: Votes that a span needs more than before the reliabilities are known; names have no form of their own, so one vote is no majority.
NEEDED = {"name": 1.5}
_LISTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("votes", pa.string())]))


def _trained(documents: DataFrame, key: str, with_text: bool) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """Rows (key, text, candidates) and the chance of every (kind, votes).

    Pass 1 harvests the gazetteers from all texts, pass 2 writes the candidates of every row; the distinct vote patterns
    with their numbers (bounded by the labelers, not by the corpus) train the reliabilities and the classifier.
    """
    spark = documents.sparkSession
    known = gazetteer(documents)
    kind_of = dict(documents.dtypes)[key]
    if known.count() <= MAX_NAMES:
        rows = known.collect()
        names = spark.sparkContext.broadcast(tuple(frozenset(r["word"] for r in rows if r["role"] == role) for role in ROLES))
        texts = documents.select(key, "text")
    else:
        names, texts = None, _with_names(documents, known, key)

    def find(batches):
        for batch in batches:
            own = [names.value] * len(batch) if names else [tuple(frozenset(x or ()) for x in row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            lists = [[{"kind": k, "start": a, "stop": b, "votes": v} for k, a, b, v in candidates_of(text, *sets)] if text else [] for text, sets in zip(batch.column(1).to_pylist(), own)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, _LISTS)], [key, "text", "candidates"])
            if not with_text:
                texts_ = [[t[c["start"] : c["stop"]] for c in found] if found else [] for t, found in zip(batch.column(1).to_pylist(), lists)]
                some = pa.array([bool(x) for x in lists])
                made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, _LISTS), pa.array(texts_, pa.list_(pa.string()))], [key, "candidates", "texts"]).filter(some)
            yield made

    columns = "text string, candidates array<struct<kind: string, start: int, stop: int, votes: string>>" if with_text else "candidates array<struct<kind: string, start: int, stop: int, votes: string>>, texts array<string>"
    found = staged(texts.mapInArrow(find, f"{key} {kind_of}, {columns}"), "candidates")
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().collect():
        counts[r["kind"]][r["votes"]] = r["count"]
    return found, {(k, v): p for k in KINDS for v, p in span_classifier(counts[k], needed=NEEDED.get(k, 0.0), bounds=BOUNDS.get(k, _ANY)).items()}


def _decided(candidates: list[dict], chances: dict, threshold: float) -> list[int]:
    """Numbers of the candidates that are kept: likely ones; of overlapping ones the first kind of KINDS, then the first in the text."""
    taken_a: list[int] = []
    taken_b: list[int] = []
    out = []
    for i in sorted(range(len(candidates)), key=lambda i: (KINDS.index(candidates[i]["kind"]), candidates[i]["start"])):
        c = candidates[i]
        if chances.get((c["kind"], c["votes"]), 0.0) >= threshold:
            k = bisect_left(taken_b, c["start"] + 1)
            if k == len(taken_a) or taken_a[k] >= c["stop"]:
                taken_a.insert(k, c["start"])
                taken_b.insert(k, c["stop"])
                out.append(i)
    return out


def spans(documents: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, kind, start, stop, found_text) of personal information; start and stop count code points.

    Regex, gazetteer and context labelers vote on every candidate; expectation-maximisation estimates how far each can be
    trusted and trains the classifier that decides on every candidate. Null and empty texts give nothing; whole texts of any
    length are read; repeated rows give their spans again. No text is shuffled.
    """
    found, chances = _trained(documents, key, False)
    shared = documents.sparkSession.sparkContext.broadcast(chances)

    def decide(batches):
        for batch in batches:
            at, rows = [], []
            for i, (candidates, texts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for j in _decided(candidates, shared.value, threshold):
                    c = candidates[j]
                    at.append(i)
                    rows.append((c["kind"], c["start"], c["stop"], texts[j]))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], [key, "kind", "start", "stop", "found_text"])

    return found.mapInArrow(decide, f"{key} {dict(documents.dtypes)[key]}, kind string, start int, stop int, found_text string")


def redacted(documents: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, text, n_replaced): the texts with every span replaced by its placeholder, all else unchanged.

    The decisions are taken and the texts replaced in one pass over the rows written with their candidates, so no text is
    shuffled. A text without spans stays as it is, null stays null; repeated rows come out again.
    """
    found, chances = _trained(documents, key, True)
    shared = documents.sparkSession.sparkContext.broadcast(chances)

    def replace(batches):
        for batch in batches:
            texts, numbers = [], []
            for text, candidates in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kept = sorted((candidates[j]["start"], candidates[j]["stop"], candidates[j]["kind"]) for j in _decided(candidates or [], shared.value, threshold))
                made, at = [], 0
                for a, b, kind in kept:
                    made += [text[at:a], PLACEHOLDERS[kind]]
                    at = b
                texts.append(None if text is None else "".join(made) + text[at:])
                numbers.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(numbers, pa.int32())], [key, "text", "n_replaced"])

    return found.mapInArrow(replace, f"{key} {dict(documents.dtypes)[key]}, text string, n_replaced int")
