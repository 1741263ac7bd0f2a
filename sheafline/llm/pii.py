"""Personal information in free text: finds it and puts typed placeholders in its place.

Numbers (phones, identity numbers) and dates become format-preserving pseudonyms: a keyed Feistel
permutation over the digits and letters of the value keeps its form, a number whose check signs
are right gets right ones again, and equal values get equal pseudonyms in all documents.  Names,
addresses and e-mail addresses get a keyed tag.  What is found is what is replaced: the values
of numbers in `find_pii` are read back from their pseudonyms.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows

KINDS = ("email", "phone", "idno", "address", "name")

# --- e-mail -----------------------------------------------------------------------------
_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s|\s?[(\[]punto[)\]]\s?|\s?[(\[]point[)\]]\s?|\s?[(\[]punkt[)\]]\s?)"
_AT = r"(?:\s?@\s?|\s?[(\[](?:at|arroba|arobase)[)\]]\s?|\sat\s|&#64;|%40)"
_WORD = r"[A-Za-z0-9_+](?:[A-Za-z0-9_+-]*[A-Za-z0-9_+])?"
EMAIL = re.compile(rf"(?<![\w.@-])({_WORD}(?:{_DOT}{_WORD})*)({_AT})({_WORD}(?:{_DOT}{_WORD})*{_DOT}[A-Za-z]{{2,24}})(?![\w@]|-\w)", re.I)
_SPELLED = re.compile(r"^\s*(?:[(\[](?:at|arroba|arobase)[)\]]|at)\s*$", re.I)


def _plain_email(m: re.Match) -> str:
    dots = lambda s: re.sub(_DOT, ".", re.sub(r"\s+", " ", s), flags=re.I)
    return (dots(m.group(1)) + "@" + dots(m.group(3))).lower()


# --- numbers ----------------------------------------------------------------------------
# Words that announce a number of a person, a phone, or something else.
ID_CUE = re.compile(r"(?:national id|\bid(?:entity)?(?: card)?(?: no\.?| number)?|\bni no\.?|national insurance|social security|security number|passport|pass(?:nummer|eport)|ausweis\w*|steuer-?id\w*|steuernummer|personalausweis|sozialversicherung\w*|dni|nie|nif|pasaporte|documento|document no\.?|identity \w+(?: \w+){0,3}|carte d.identité|sécurité sociale|numéro fiscal|passeport|tax (?:id|number)|driving licen[cs]e|driver.s licen[cs]e|identification(?: no\.?| number)?|insurance number|tax reference|matriculation|carnet|cédula|führerschein\w*|permis de conduire)", re.I)
PHONE_CUE = re.compile(r"(?:\b(?:phone|tel|tél|tlf|tfno|telefon|teléfono|téléphone|mob|mobile?|mobil|móvil|portable|fax|call|text|cell|handy|hotline|line|extension|pager|rappeler|répond|llamar|llame|rückruf|anruf\w*|reach|driver|courier|agent|desk|office|kontakt|contact|fahrer|chauffeur|chófer|conductor|atiende|contesta|dial|joignable|localizable|erreichbar|unter|ring|whatsapp)\b)", re.I)
OTHER_CUE = re.compile(r"(?:\b(?:serial(?: no\.?| number)?|part(?: number| no\.?)?|order(?: no\.?)?|invoice|booked under|ref\.?|reference|firmware|version|ticket|batch|unit|model|item|article|account|iban|customer no\.?|contract no\.?|tracking|lot|code|seriennummer|teilenummer|artikel\w*|bestell\w*|rechnung\w*|auftrag\w*|kundennummer|vorgang|charge|gerät|modell|teil|pièce|commande|facture|n° de série|série|dossier|modèle|appareil|pedido|factura|serie|pieza|modelo|unidad|lote|caso|expediente|case|replaces|since|seit|depuis|desde)\b[\s.:#]*(?:is|no|nr|n°|number)?[\s.:#]*)\Z", re.I)
EXTENSION = re.compile(r"\s*\(?(?:ext|x|extension|durchwahl|poste|extensión)\.?\s*\d{1,5}\)?", re.I)

ID_FORMS = (
    re.compile(r"(?<![\w-])[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D](?![\w])"),
    re.compile(r"(?<![\w-])[XYZ]-?\d{7}-?[A-Za-z](?![\w])"),
    re.compile(r"(?<![\w.-])\d{2}\.\d{3}\.\d{3}-?[A-Za-z](?![\w])"),
    re.compile(r"(?<![\w.-])\d{8}-?[A-HJ-NP-TV-Za-hj-np-tv-z](?![\w])"),
    re.compile(r"(?<![\w-])\d{2}[A-Z]{2}\d{5}(?![\w])"),
    re.compile(r"(?<![\w-])[A-Z]{1,2}\d{7,8}(?![\w])"),
    re.compile(r"[A-Z](?<![\w-].)(?=[A-Z]*\d[A-Z0-9]*\d)[A-Z0-9]{8}\d?(?![\w])"),
    re.compile(r"(?<![\w.-])[1-478]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}(?![\w-]|\s?\d)"),
    re.compile(r"(?<![\w.-])\d{2}\s\d{3}\s\d{3}\s\d{3}(?![\w-]|\s\d)"),
    re.compile(r"(?<![\w.+/-])\d{11}(?![\w-])"),
    re.compile(r"(?<![\w.+/-])\d{3}[-\s]\d{2}[-\s]\d{4}(?![\w-])"),
)
#: Forms that only a cue makes an identity number: others use them too.
ID_NEEDS_CUE = frozenset((5, 6, 8, 9, 10))
#: Forms with check signs of one in twenty and rarer; the form of letters and digits in any order.
CHECKED, MIXED = frozenset((1, 2, 3, 7)), 6
#: Signs before a number that are looked at for its cue; the last sentence in them counts.
SENTENCE = 200
PHONE_FORMS = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00)\d{1,3}[\s.-]?(?:\(0\)[\s.-]?)?(?:\(?\d{1,5}\)?[\s./-]?){1,5}\d{2,}"
    r"|\(\d{2,5}\)[\s./-]?\d{2,5}(?:[\s./-]?\d{2,5}){1,3}"
    r"|0\d{1,4}/\d{3,8}(?:[\s-]\d{1,5}){0,2}"
    r"|0\d(?:[\s.]\d{2}){4}"
    r"|0\d{2,4}\s\d{3,4}\s\d{3,4}"
    r"|0\d{9,10}"
    r"|\d{3}[.\s-]\d{3}[.\s-]\d{4}"
    r"|\d{3}[.\s-]\d{3}[.\s-]\d{3}"
    r"|\d{3}(?:\s\d{2}){3}"
    r"|[6-9]\d{8}"
    r")(?![\w-]|[.,]\d)"
)
#: Without a cue only forms with a country or area prefix are taken as phones.
PHONE_SURE = re.compile(r"(?:\+|00[1-9])|\(\d{2,5}\)|0\d{1,4}/|0\d(?:[\s.]\d{2}){4}\Z|0\d{2,4}\s\d{3,4}\s\d{3,4}\Z|0[1-9]\d{8,9}\Z|[2-9]\d{2}\.\d{3}\.\d{4}\Z")

# --- addresses --------------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_EN = r"(?:Street|Str\.|St\.|St|Road|Rd\.?|Lane|Ln\.?|Close|Avenue|Ave(?:\.(?=\s?[,a-z]))?|Crescent|Cres\.?|Way|Drive|Dr\.|Court|Ct\.|Place|Pl\.|Square|Sq\.|Terrace|Gardens|Grove|Hill|Row|Walk|Boulevard|Blvd\.?|Parade|Mews)"
_FR = r"(?:rue|avenue|av\.|boulevard|bd\.?|chemin|ch\.|allée|allées|quai|place|pl\.|impasse|cours|route|square|passage|sentier|esplanade|faubourg|fg\.?)"
_ES = r"(?:Calle|C/|Cl\.|Avenida|Avda\.?|Av\.|Paseo|P\.º|Plaza|Pza\.?|Camino|Cno\.?|Ronda|Travesía|Carretera|Ctra\.?|Glorieta|Callejón|Rambla)"
_DE = r"(?:straße|strasse|str\.|platz|weg|allee|gasse|ring|damm|ufer|steig|stieg|mühle|hof|markt|graben|chaussee|wall|pfad)"
_NO = r"\d{1,5}"
ADDRESSES = tuple(
    re.compile(x, f)
    for x, f in (
        (rf"(?<![\w,.-]){_NO}\s?[A-Za-z]?,?\s(?:{_CAP}\s){{1,3}}{_EN}(?![\w])", 0),
        (rf"(?<![\w-]){_NO}(?:\s?(?:bis|ter|quater|[A-Da-d]\b))?,?\s{_FR}\s(?:(?:de la|de l'|de l’|de|du|des|d'|d’|la|le|les)\s?)?{_CAP}(?:(?:\s|-)(?:(?:de|du|des|la|le)(?:\s|-))?{_CAP}(?=[,\s.]|\Z)(?!\s?{_CAP}))?", 0),
        (rf"(?<![\w-]){_ES}\s(?:(?:de la|de los|de las|del|de|la|el|los|las)\s)?{_CAP}(?:\s(?:de\s|del\s|y\s)?{_CAP})?,?\s(?:(?:n\.?\s?[ºo°]\.?|núm\.?|nº|No\.?)\s?)?{_NO}(?:\s?(?:bis|ter)\b|[A-Za-z]\b)?", 0),
        (rf"(?<![\w-])(?:(?:An der|An den|Am|Auf der|Auf dem|In der|Im|Zum|Zur|Alte|Alter|Neue|Neuer|Große|Kleine|Obere|Untere)\s)?[A-ZÄÖÜ][\wäöüß-]*{_DE}\s{_NO}(?:\s?[a-z]\b|[A-Z]\b)?(?![\w])", 0),
        (rf"(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*er\s(?:Allee|Straße|Strasse|Str\.|Weg|Platz|Ring|Damm|Ufer|Chaussee|Markt|Gasse)\s{_NO}(?:\s?[a-z]\b|[A-Z]\b)?(?![\w])", 0),
        (rf"(?<![\w-])(?:An der|An den|Am|Auf der|Auf dem|In der|Im|Zum|Zur)\s(?!(?:Gerät|Modell|Teil|Charge|Werk|Halle|Tor|Fall|Jahr|Tag|Montag|Dienstag|Mittwoch|Donnerstag|Freitag|Samstag|Sonntag|Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Einheit|Platz|Punkt|Kapitel|Raum|Linie|Prüfstand|Lager)\b)[A-ZÄÖÜ][\wäöüß-]+\s{_NO}(?:\s?[a-z]\b|[A-Z]\b)?(?![\w.:])", 0),
    )
)

# --- names ------------------------------------------------------------------------------
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herrn?|Frau|Monsieur|Madame|Mademoiselle|Mme|Mlle|M|MM|Sra|Sr|Srta|Don|Doña|Señora?)"
TITLES = ("M", "Dr", "Prof", "S", "Herr", "Frau", "Do")
_C = r"(?:(?:Mc|O['’]|D['’]|Mac)?[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ'’]+|[A-ZÀ-ÖØ-Þ'’]+)(?:-(?:Mc|O['’])?[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+))*)"
_I = r"(?:[A-ZÀ-ÖØ-Þ]\.(?:-?\s?[A-ZÀ-ÖØ-Þ]\.)?)"
_PART = r"(?:(?:de la|de los|van der|van den|von der|de|del|van|von|di|da|la|le)\s)?"
NAME = rf"(?:{_C},\s(?:{_C}|{_I})|{_I}\s{_PART}{_C}|{_C}\s{_I}\s{_PART}{_C}|{_C}\s{_PART}{_C}|{_C}\s{_I})"
TITLED = re.compile(rf"(?<![\w.-])((?:{_TITLE}\b\.?\s)+)({_C}(?:\s{_C})?)")
# Words before or after a person's name.
BEFORE_CUES = (
    "spoke with|spoken to|raised by|approved by|checked by|signed by|opened by|written by|prepared by|reported by|handled by|thanks to|thank you|thank you,|attn|attn.|contact person|cc|c.c.|bcc|signed|dear"
    "|stammt von|bearbeitet von|geprüft von|erstellt von|gezeichnet von|genehmigt von|rücksprache mit|gesprochen mit|dank an|z.hd.|z. hd."
    "|ouvert par|traité par|approuvé par|validé par|signé par|vu avec|parlé avec|merci à|habló con|hablado con|abierto por|aprobado por|revisado por|tramitado por|firmado por|gracias a|visto con"
)
CUE_ENDS = tuple(BEFORE_CUES.split("|"))
CUE_LAST = frozenset(c.rsplit(" ", 1)[-1] for c in CUE_ENDS)
BEFORE = re.compile(r"\b(?:" + "|".join(re.escape(c) for c in sorted(CUE_ENDS, key=len, reverse=True)) + r")\s?:?\s", re.I)

AFTER = re.compile(rf"({NAME})(?=\s(?:signed the|has signed|hat das|hat die|hat den|a signé|a validé|firmó|ha firmado|signed off)\b)")
NAME_RX = re.compile(NAME)
TITLE_FIRST = re.compile(rf"{_TITLE}\b\.?(?:\s|\Z)")
#: A company follows the name.
COMPANY = re.compile(r"\s?(?:&|\+|GmbH|AG\b|KG\b|SA\b|S\.A|SL\b|S\.L|SARL|SAS\b|Ltd|LLC|Inc|Corp|Co\b|PLC|Service\b|Group|G\.M\.B\.H|Holdings?\b|Partners\b|Bros\b|OHG\b)|\s(?:invoices?|branch|accounts?|brand|model|series|products?|contracts?)\b")
PAIR = re.compile(rf"(?<![\w.@/-])({_C})(,?\s)(?={_C}|{_I})")
WORDS = re.compile(rf"(?<![\w.@/-])(?:{_C}|{_I})")


def _upper_run(text: str, a: int, b: int) -> bool:
    """Whether the words around a span are in capitals too (then capitals mean nothing)."""
    left, right = re.findall(r"[^\W\d_]{2,}", text[max(0, a - 40) : a])[-2:], re.findall(r"[^\W\d_]{2,}", text[b : b + 40])[:2]
    near = left + right
    return bool(near) and all(w.isupper() for w in near)


def _cue_start(low: str, p: int) -> int:
    """Where the cue that ends before position p begins."""
    e = len(low[max(0, p - 30) : p].rstrip(" :")) + max(0, p - 30)
    return min((e - len(c) for c in CUE_ENDS if low.endswith(c, 0, e)), default=p)


#: Words of which one stands in every address of the pattern at the same place in ADDRESSES.
ADDRESS_SIGNS = tuple(
    tuple(x.split("|"))
    for x in (
        " Street| Str.| St.| St| Road| Rd| Lane| Ln| Close| Ave| Cres| Way| Drive| Dr.| Court| Ct.| Place| Pl.| Square| Sq.| Terrace| Gardens| Grove| Hill| Row| Walk| Boulevard| Blvd| Parade| Mews",
        " rue | avenue | av. | boulevard | bd| chemin | ch. | allée| quai | place | pl. | impasse | cours | route | square | passage | sentier | esplanade | faubourg | fg",
        "Calle |C/ |Cl. |Avenida |Avda|Av. |Paseo |P.º |Plaza |Pza|Camino |Cno|Ronda |Travesía |Carretera |Ctra|Glorieta |Callejón |Rambla ",
        "straße |strasse |str. |platz |weg |allee |gasse |ring |damm |ufer |steig |stieg |mühle |hof |markt |graben |chaussee |wall |pfad ",
        "er Allee |er Straße |er Strasse |er Str. |er Weg |er Platz |er Ring |er Damm |er Ufer |er Chaussee |er Markt |er Gasse ",
        "An der |An den |Am |Auf der |Auf dem |In der |Im |Zum |Zur ",
    )
)
#: Where a capitalised word may begin, and digits that lie close enough to be one number.
#: Nouns that a number follows.
NUMBERED = frozenset("unit batch model part item lot order serial no nr number ref invoice ticket room hall gate line page figure table step stage phase case file version machine pump valve type series code gerät modell teil charge raum halle tor seite schritt fall typ auftrag pièce appareil modèle lot salle page étape dossier unidad pieza modelo lote sala página caso pedido".split())
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ](?<![\w.@/-].)")
DIGITS = re.compile(r"\d(?:[A-Z\s().,/+-]{0,4}\d){4,}")
FAMILY_GIVEN = re.compile(_C)
AFTER_SIGNS = (" signed ", " has signed", " hat d", " a signé", " a validé", " firmó", " ha firmado")


class Finder:
    """Finds (start, end, kind, value) in a text.  given, family: known names in any case."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = ()):
        self.given = {g.strip().lower() for g in given if g and g.strip()}
        self.family = {f.strip().lower() for f in family if f and f.strip()}

    def find(self, text: str | None) -> list[tuple[int, int, str, str]]:
        if not text:
            return []
        # Positions stay: every kind of white space becomes one blank of its own length.
        t = text if text.isprintable() else re.sub(r"\s", " ", text)
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(t))
        flat, at = self._flat(t)

        def free(a: int, b: int) -> bool:
            return not any(taken[at(a) : at(b - 1) + 1])

        def add(a: int, b: int, kind: str, value: str) -> None:
            a, b = at(a), at(b - 1) + 1
            found.append((a, b, kind, value))
            taken[a:b] = b"\1" * (b - a)

        self._emails(flat, lambda a, b, v: add(a, b, "email", v))
        self._numbers(flat, free, add)
        if re.search(r"\d", flat):
            for rx, signs in zip(ADDRESSES, ADDRESS_SIGNS):
                if not any(x in flat for x in signs):
                    continue
                for m in rx.finditer(flat):
                    a, b = m.span()
                    # "Unit 12 Mill Road": the number belongs to what is before it.
                    if free(a, b) and not (flat[a].isdigit() and flat[flat.rfind(" ", 0, a - 1) + 1 : a - 1].lower() in NUMBERED):
                        add(a, b, "address", flat[a:b].rstrip(","))
        self._names(flat, free, add)
        return sorted(found)

    @staticmethod
    def _flat(t: str):
        """The text with runs of blanks as one, and a map of its positions to the text's."""
        if "  " not in t:
            return t, lambda i: i
        starts, more, gone = [], [0], 0
        for m in re.finditer(r"  +", t):
            starts.append(m.start() + 1 - gone)  # the first position behind the blank that stays
            gone += m.end() - m.start() - 1
            more.append(gone)
        return re.sub(r"  +", " ", t), lambda i: i + more[bisect_right(starts, i)]

    @staticmethod
    def _emails(t: str, add) -> None:
        low = t.lower()
        spelled = " at " in low and "dot" in low
        if "@" not in t and not spelled and "(at)" not in low and "[at]" not in low and "arro" not in low and "&#64;" not in t and "%40" not in t:
            return
        for m in EMAIL.finditer(t):
            a, b = m.span()
            if _SPELLED.match(m.group(2)) and m.group(2).strip().lower() == "at":
                # "at" between words is an address only if its dots are spelled or written too.
                if not re.search(r"\sdot\s|[(\[]dot[)\]]|\.", m.group(3), re.I) or ("." in m.group(3) and not re.search(r"\bdot\b", m.group(0), re.I)):
                    continue
            value = _plain_email(m)
            add(a, b, value.removeprefix("mailto:"))

    @staticmethod
    def _numbers(t: str, free, add) -> None:
        spots = {(m.start(), -m.end(), 0, MIXED) for m in ID_FORMS[MIXED].finditer(t)}
        for w in DIGITS.finditer(t):
            # The forms are looked for around digits that lie close together only.
            lo, hi = max(0, w.start() - 6), w.end() + 6
            for k, rx in enumerate(ID_FORMS):
                if k != MIXED:
                    spots.update((m.start(), -m.end(), 0, k) for m in rx.finditer(t, lo, hi))
            spots.update((m.start(), -m.end(), 1, 0) for m in PHONE_FORMS.finditer(t, lo, hi))
        for a, e, what, k in sorted(spots):
            b = -e
            if not free(a, b):
                continue
            left = t[max(0, a - SENTENCE) : a]
            # Only the sentence's own words before the number count.
            left = re.split(r"[.;!?]\s(?=[A-ZÀ-Þ])|(?<=\d)\s(?=[A-Z][a-z]+ [a-z])", left)[-1]
            right = t[b : b + 40]
            if OTHER_CUE.search(left):
                continue
            id_at = max((m.end() for m in ID_CUE.finditer(left)), default=-1)
            ph_at = max((m.end() for m in PHONE_CUE.finditer(left)), default=-1)
            id_right = re.match(r"\s(?:is|was|lag|a été|figura)\b[^.]{0,25}(?:pay ?slip|file|gate|shown|vor|vue)", right, re.I) is not None
            digits = re.sub(r"\D", "", t[a:b])
            if what == 0:
                sure = k not in ID_NEEDS_CUE
                value = re.sub(r"[^A-Z0-9]", "", t[a:b].upper())
                # A right check sign says more than a word of phones nearby.
                right_sign = k in CHECKED and has_right_check(value)
                if right_sign or (id_at > ph_at) or (id_right and ph_at < 0) or (sure and ph_at < 0) or (sure and k in (0, 1, 2)):
                    add(a, b, "idno", value)
            elif 8 <= len(digits) <= 15 and ph_at >= id_at and (ph_at >= 0 or PHONE_SURE.match(t[a:b])):
                if re.match(r"\d{4}-\d{2}-\d{2}\Z", t[a:b]):
                    continue
                add(a, b, "phone", digits)

    def _names(self, t: str, free, add) -> None:
        given, family = self.given, self.family

        def put(a: int, b: int) -> None:
            while b > a and t[b - 1] in ", ":
                b -= 1
            if b > a and free(a, b) and not COMPANY.match(t[b:]):
                add(a, b, "name", t[a:b])

        caps = [m.start() for m in CAPITAL.finditer(t)]
        low = t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        for p in caps:
            if p < 3 or t[p - 1] != " ":
                continue
            e = p - 1 if t[p - 2] != ":" else p - 2 - (t[p - 3] == " ")
            if low[low.rfind(" ", 0, e) + 1 : e].lstrip("(") in CUE_LAST:
                m = BEFORE.match(t, _cue_start(low, p))
                n = m and m.end() == p and NAME_RX.match(t, p)
                if n and not TITLE_FIRST.match(n.group(0)):
                    put(*self._trim(t, n.start(), n.end()))
        if any(x in t for x in AFTER_SIGNS):
            for m in AFTER.finditer(t):
                if not TITLE_FIRST.match(m.group(1)):
                    put(*m.span(1))
        for p in caps:
            m = t.startswith(TITLES, p) and TITLED.match(t, p)
            if not m:
                continue
            words = m.group(2).split(" ")
            a = m.start(2)
            if m.group(1).strip() in ("M", "Don", "Sir") and len(words[0]) < 3:
                continue
            before = re.search(r"(\S+)\s\Z", t[max(0, m.start() - 30) : m.start()])
            if m.group(1).startswith("M.") and before and before.group(1).lower() in given:
                continue  # an initial, not a title
            two = len(words) == 2 and (words[0].lower() in given) and not (words[1].lower() in _STARTERS)
            put(a, a + (len(m.group(2)) if two else len(words[0])))
        begin = set(caps)
        for p in caps:
            # The next word has to be capitalised too.
            m = t.find(" ", p) + 1 in begin and PAIR.match(t, p)
            if not m:
                continue
            w, sep = m.group(1), m.group(2)
            n = WORDS.match(t, m.end())
            if not n:
                continue
            x, lw = n.group(0), w.lower()
            lx = x.lower()
            if sep.startswith(","):
                # Family, Given
                if lx in given and (lw in family or (w.isupper() and not _upper_run(t, m.start(), n.end()))) and lw not in _STARTERS:
                    put(m.start(), n.end())
                elif lw in family and x.endswith(".") and len(x) == 2 and not _upper_run(t, m.start(), n.end()) and w.lower() not in _ORDINARY:
                    put(m.start(), n.end())
                continue
            known = [p for p in lx.split("-") if p in family]
            if lw in given and known and not (lw in _STARTERS and lx in _ORDINARY):
                put(m.start(), n.end())
            elif lw in given and not x.endswith(".") and lx not in _STARTERS and not _upper_run(t, m.start(), n.end()) and lw not in _ORDINARY and not re.match(r"\s\d", t[n.end() :]):
                put(m.start(), n.end())
            elif lw in given and x.endswith(".") and lw not in _ORDINARY:
                put(m.start(), n.end())
            elif known and lw not in _STARTERS and lw not in _ORDINARY and lx not in _ORDINARY and not _upper_run(t, m.start(), n.end()) and not re.match(r"\s\d", t[n.end() :]):
                put(m.start(), n.end())

    def _trim(self, t: str, a: int, b: int) -> tuple[int, int]:
        """A name after a cue ends before a word that begins a sentence."""
        s = t[a:b]
        words = s.split(" ")
        if len(words) > 1 and not words[0].endswith(",") and words[-1].lower().rstrip(".") in _STARTERS:
            b = a + len(s.rsplit(" ", 1)[0])
            if " " not in t[a:b]:
                return a, a  # one word alone is no full name
        return a, b


# Words that begin sentences, and names that are ordinary words too.
_STARTERS = frozenset(
    "the a an as at in on by for from with after before between during within until since our we this that these those it its i he she they you your my his her their there here however meanwhile later next near over under outside through across despite because surprisingly although whereas while unit part model batch order reading both all most no please send deliver pick address phone call contact write thanks approved cc tel mob mobil passport national serial firmware inlet ahead according"
    " der die das den dem des ein eine einen einem einer nach vor bei bis seit mit ohne im am an auf aus zwischen während innerhalb trotz wegen gemäß laut unter über neben in von zum zur außerdem allerdings dagegen deshalb inzwischen insgesamt später überraschend wie gerät teil modell charge messwert bitte lieferung anschrift abholung kontakt rückruf"
    " le la les l un une des du de au aux en dans sur sous par pour avec sans avant après depuis entre pendant malgré selon chez cependant entre-temps ensuite plus tard comme notre nous appareil pièce modèle lot commande livrer adresse écrire dossier"
    " el los las lo un una unos unas del al en con sin por para según antes después desde entre durante tras pese sobre más además sin embargo mientras unidad pieza modelo lote pedido lectura nuestra nuestro se entregar dirección escribir llamar".split()
)
_ORDINARY = frozenset("will may rose faith grace mark field hunter stone winter rivers baker bill art frank grant hope joy june april august dawn summer young long short white brown black green wood woods hill park lane king page bush price".split())


# --- pseudonyms -------------------------------------------------------------------------
def _round(key: bytes, tweak: bytes, half: str, r: int) -> int:
    return int.from_bytes(hashlib.blake2b(half.encode(), key=key[:64], salt=bytes([r]) + tweak[:15].ljust(15, b"\0"), digest_size=8).digest(), "big")


def _num(s: str, radix: list[int]) -> int:
    n = 0
    for c, r in zip(s, radix):
        n = n * r + (ord(c) - (48 if r == 10 else 65))
    return n


def _text(n: int, radix: list[int]) -> str:
    out = []
    for r in reversed(radix):
        n, d = divmod(n, r)
        out.append(chr(d + (48 if r == 10 else 65)))
    return "".join(reversed(out))


def feistel(value: str, key: bytes, kind: str = "", back: bool = False, rounds: int = 10) -> str:
    """A keyed permutation of the digits and letters of `value`; all else stays in place.

    Digits map to digits and letters to letters of their case.  `back` undoes it.  Values of one
    sign are permuted too (their left half is empty and the round still adds a keyed shift).
    """
    where = [i for i, c in enumerate(value) if c.isascii() and c.isalnum()]
    if not where:
        return value
    core = "".join(value[i] for i in where)
    radix = [10 if c.isdigit() else 26 for c in core]
    up = core.upper()
    h = len(up) // 2
    a, b, ra, rb = up[:h], up[h:], radix[:h], radix[h:]
    size = lambda rad: __import__("math").prod(rad)
    sa, sb = size(ra), size(rb)
    tweak = kind.encode()
    order = range(rounds - 1, -1, -1) if back else range(rounds)
    sign = -1 if back else 1
    for r in order:
        if r % 2 == 0:
            b = _text((_num(b, rb) + sign * _round(key, tweak, a, r)) % sb, rb)
        else:
            a = _text((_num(a, ra) + sign * _round(key, tweak, b, r)) % sa, ra) if ra else a
    out = list(value)
    for i, c in zip(where, a + b):
        out[i] = c if value[i].isdigit() or value[i].isupper() else c.lower()
    return "".join(out)


# --- numbers with check signs -------------------------------------------------------------
# The check letters of Spanish identity numbers, by the remainder of 23.
_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _check_letter(body: str) -> str:
    return _LETTERS[int(body.translate(str.maketrans("XYZ", "012"))) % 23]


def _check_key(body: str) -> str:
    return f"{97 - int(body) % 97:02d}"


def _check_digit(body: str) -> str:
    """ISO 7064, MOD 11,10."""
    p = 10
    for c in body:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


#: (form, signs that stay, signs of the check, the check of a body).
CHECKS = (
    (re.compile(r"\d{8}[A-Z]"), 0, 1, _check_letter),
    (re.compile(r"[XYZ]\d{7}[A-Z]"), 1, 1, _check_letter),
    (re.compile(r"[1-478]\d{14}"), 1, 2, _check_key),
    (re.compile(r"\d{11}"), 0, 1, _check_digit),
)


def has_right_check(value: str) -> bool:
    return any(rx.fullmatch(value) and check(value[:-n]) == value[-n:] for rx, _, n, check in CHECKS)


def pseudonym(value: str, key: bytes, kind: str, back: bool = False) -> str:
    """The keyed permutation of a plain number, or with `back` its inverse.

    A number with right check signs keeps them right: its body is permuted and the check made
    anew.  Any other number is permuted until its check is not right either, so both sets stay
    apart and the map can be undone.
    """
    if kind == "idno" and has_right_check(value):
        for rx, head, n, check in CHECKS:
            if rx.fullmatch(value) and check(value[:-n]) == value[-n:]:
                body = value[:head] + feistel(value[head:-n], key, kind, back)
                return body + check(body)
    out = feistel(value, key, kind, back)
    while kind == "idno" and has_right_check(out):
        out = feistel(out, key, kind, back)
    return out


# --- dates --------------------------------------------------------------------------------
DATE = re.compile(r"(?<![\w./-])(?:(\d{4})-(\d{2})-(\d{2})|(\d{1,2})([./])(\d{1,2})\5(\d{4}))(?![\w/-]|\.\d)")
#: Dates that are permuted: days from 1900 to 2099.
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049


def dates(text: str | None) -> list[tuple[int, int, datetime.date]]:
    """(start, end, day) of the valid dates of a text: year-month-day, or day, month and year
    with dots or strokes."""
    out = []
    for m in DATE.finditer(text or ""):
        y, mo, d = (m.group(1), m.group(2), m.group(3)) if m.group(1) else (m.group(7), m.group(6), m.group(4))
        try:
            day = datetime.date(int(y), int(mo), int(d))
        except ValueError:
            continue
        if 0 <= (day - FIRST_DAY).days < DAYS:
            out.append((*m.span(), day))
    return out


def laid_out(day: datetime.date, shown: str) -> str:
    """A day in the form of the date that it stands for."""
    if shown[:4].isdigit():
        return day.isoformat()
    return f"{day.day:02d}{shown[-5]}{day.month:02d}{shown[-5]}{day.year:04d}"


def permute_date(day: datetime.date, key: bytes, first: datetime.date = FIRST_DAY, days: int = DAYS, back: bool = False) -> datetime.date:
    """A keyed permutation of the days from `first` on, by cycle walking over five digits."""
    n = (day - first).days
    if not 0 <= n < days:
        raise ValueError("the date is outside the permuted range")
    while True:
        n = int(feistel(f"{n:05d}", key, "date", back))
        if n < days:
            return first + datetime.timedelta(days=n)


#: Bytes of a tag: unlike values of billions share one with a chance of about 10 ** -10 a pair.
TAG_BYTES = 12


def placeholder(kind: str, value: str, shown: str, key: bytes) -> str:
    """[KIND pseudonym]: numbers keep their form, other kinds get a keyed tag."""
    if kind in ("phone", "idno"):
        # The pseudonym is that of the plain value, so other spellings get the same; it is laid out as shown.
        signs = iter(pseudonym(value, key, kind))
        at = [i for i, c in enumerate(shown) if c.isascii() and (c.isdigit() or kind == "idno" and c.isalpha())]
        if len(at) != len(value):
            return f"[{kind.upper()} {''.join(signs)}]"
        out = list(shown)
        for i in at:
            out[i] = next(signs)
        return f"[{kind.upper()} {''.join(out)}]"
    tag = hashlib.blake2b(value.lower().encode(), key=key[:64], digest_size=TAG_BYTES).hexdigest()
    return f"[{kind.upper()} {tag}]"


def revealed(kind: str, value: str, shown: str, key: bytes) -> str:
    """The value of a finding; of a number that in its placeholder, read back with the key."""
    if kind not in ("phone", "idno"):
        return value
    signs = "".join(c for c in placeholder(kind, value, shown, key).split(" ", 1)[1] if c.isascii() and (c.isdigit() or kind == "idno" and c.isalpha()))
    return pseudonym(signs.upper(), key, kind, back=True)


def _names_of(names: DataFrame | None, limit: int) -> tuple[list[str], list[str]]:
    if names is None:
        return [], []
    rows = names.select("name", "kind").where(F.col("name").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the list of names has more than {limit} entries")
    return [r.name for r in rows if r.kind == "given"], [r.name for r in rows if r.kind == "family"]


#: The list of names goes to every task; more entries than this are refused.
MAX_NAMES = 200_000


def find_pii(docs: DataFrame, names: DataFrame | None = None, max_names: int = MAX_NAMES, key: bytes = b"sheafline") -> DataFrame:
    """(id, kind, value), one row per distinct finding of each row of docs (id, text).

    The findings are those that `redact` replaces; the value of a number is read back from its
    placeholder.  Null and empty texts give no rows.  names: (name, kind) with kind given or
    family, a small list whose size is checked; without it names are found by titles and cue words
    alone.
    """
    given, family = _names_of(names, max_names)

    def make():
        finder = Finder(given, family)

        def f(ids, texts):
            a, b, c = [], [], []
            for i, t in zip(ids, texts):
                for k, v in dict.fromkeys((k, revealed(k, v, t[x:y], key)) for x, y, k, v in finder.find(t)):
                    a.append(i), b.append(k), c.append(v)
            return a, b, c

        return f

    return map_rows(docs, ["id", "text"], make, "id long, kind string, value string")


def redact(docs: DataFrame, key: bytes, names: DataFrame | None = None, max_names: int = MAX_NAMES, with_dates: bool = False) -> DataFrame:
    """(id, redacted, n_found) for every row of docs (id, text): placeholders in place of the
    findings, all else as it stands.  A null text stays null with a count of 0.  with_dates
    replaces valid dates too, each by another date of the same form."""
    given, family = _names_of(names, max_names)

    def make():
        finder = Finder(given, family)

        def f(ids, texts):
            out, n = [], []
            for t in texts:
                got = [(a, b, placeholder(k, v, t[a:b], key)) for a, b, k, v in finder.find(t)]
                if with_dates:
                    got += [(a, b, f"[DATE {laid_out(permute_date(d, key), t[a:b])}]") for a, b, d in dates(t) if not any(x < b and a < y for x, y, _ in got)]
                parts, last = [], 0
                for a, b, s in sorted(got):
                    parts += [t[last:a], s]
                    last = b
                out.append(None if t is None else "".join(parts) + t[last:]), n.append(len(got))
            return ids, out, n

        return f

    return map_rows(docs, ["id", "text"], make, "id long, redacted string, n_found int")
