"""Quoted history and signatures in emails: a semi-Markov decoder over the lines of a mail.

A mail is cut into blocks of lines that belong together (blank lines, a change of quote mark
and cue lines end a block).  The decoder chooses the best sequence of spans, each authored,
quoted, signature or disclaimer.  A span's score is the sum of its blocks' cues, of boundary
cues where it begins, of a score of its length, and of features of the span as a whole (the
sender's name together with a contact, legal words from several sentences).  Length scores are
linear and the features of a whole span have few values, so a span's state is kept from block to
block and decoding takes time linear in the length of a mail, without a bound on spans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from sheafline.llm.arrow import map_rows

AUTHORED, QUOTED, SIGNATURE, DISCLAIMER = range(4)
LABELS = ("authored", "quoted", "signature", "disclaimer")

# Words of mail programs and of legal notes in the languages of the mails.
_HEAD = "From|Sent|To|Cc|Bcc|Subject|Date|Von|Gesendet|An|Betreff|Datum|De|Enviado(?: el)?|Para|Asunto|Fecha|Envoy[ée]|À|Objet"
HEADER = re.compile(r"\s*[*]?(%s)\s?:[*]?\s+\S" % _HEAD)
TOP = re.compile(r"\A(?:\s*\n)*(?:\s*(?:%s|Reply-To|Attachments?)\s?:[^\n]*(?:\n[ \t]+[^\n]*)*(?:\n|\Z))+" % _HEAD)
WROTE = re.compile(
    r"\s*(?:(?:On|Am|Le|El|Il|Op)\b.{2,160}?\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80}:|.{2,120}?\b(?:wrote on|wrote at|schrieb am|escribió el|a écrit le)\b.{2,60}:|.{2,120}<[^<>]+@[^<>]+>\s*(?:wrote|schrieb|a écrit|escribió)\s*:)\s*\Z",
    re.I | re.S,
)
FORWARD = re.compile(r"\s*(?:-{3,}|_{3,}|={3,})\s*(?:Original|Forwarded|Ursprüngliche|Weitergeleitete|Message|Mensaje|Begin|Nachricht|Courriel|Correo)\b[^\n]*?(?:-{3,}|_{3,}|={3,}|:)\s*\Z|\s*Begin forwarded message\s*:\s*\Z", re.I)
RULE_LONG = re.compile(r"\s*[_=-]{12,}\s*\Z")
MARK = re.compile(r"\s{0,3}(?:>|\|(?=\s?[^\s|][^|]*$))")
NUMBER_AFTER = re.compile(r"\s{0,3}>\s?=?\s?\d")
DASHES = re.compile(r"(?:-- ?|—|_{2,10}|-{2}\s*)\Z")
STARS = re.compile(r"\s*(?:\*{3,}|-{3,10}|={3,}|#{3,})\s*\Z")
DEVICE = re.compile(r"\s*(?:Sent (?:from (?:my|the|a)\b|on the move|on the go|via |with )|Get (?:the |Outlook|our )\S*.{0,30}\b(?:app|for)\b|Von unterwegs|(?:Von meinem|Gesendet von (?:meinem|unterwegs)|Gesendet mit)\b|Envoy[ée] (?:depuis|de) mon\b|Envoy[ée] en d[ée]placement|Enviado desde (?:mi|el)\b|Diese Nachricht wurde von meinem|Obtenga? la app|Hol dir die|Téléchargez l.app)", re.I)
PHONE = re.compile(r"(?:\b(?:phone|tel|tél|tlf|tfno|teléfono|telefon|téléphone|mobile?|móvil|fax|direct|durchwahl)\b\.?\s*:?\s*)?\+?\(?\d[\d\s()./-]{6,}\d", re.I)
CONTACT = re.compile(r"\s*(?:phone|tel|tél|tlf|tfno|teléfono|telefon|téléphone|mobile?|móvil|fax)\b\.?\s*:?\s*\+?\(?\d[\d\s()./-]{5,}\d\s*\Z", re.I)
MAIL_ONLY = re.compile(r"\s*(?:e-?mail\s*:\s*)?<?[\w.+-]+@[\w-]+(?:\.[\w-]+)+>?\s*\Z", re.I)
PIPES = re.compile(r"[^|\n]{3,60}\|[^|\n]{2,60}\|[^\n]{2,120}\Z")
SENTENCE = re.compile(r"[.!?]\s*\Z")
CLOSING = re.compile(r"\s*(?:(?:kind |best |warm )?regards|best wishes|best|cheers|thanks|thank you|many thanks|sincerely|yours \w+|mit (?:freundlichen|besten|vielen) grüßen|(?:viele|beste|freundliche|liebe|herzliche) grüße|danke|vielen dank|gruß|cordialement|bien à vous|merci|salutations|bien cordialement|un saludo|saludos|gracias|atentamente|un abrazo)\s*[,.!]?\s*\Z", re.I)
CAUTION = re.compile(r"\s*[\[(*]{0,3}\s*(?:external|externe[rs]?|extern|courriel externe|correo externo|caution|vorsicht|warning|achtung|attention|atención)\b[^\n]{0,160}\Z", re.I)
CAUTION_WORDS = re.compile(r"\b(?:sender|nachricht|absender|mail|e-mail|message|courriel|correo|links?|attachments?|outside|care|vorsicht|prudence|precaución)\b", re.I)
#: Groups of legal cues; a span that shows several groups, or one of the first few, is a disclaimer.
LEGAL = tuple(
    re.compile(x, re.I)
    for x in (
        r"(?:e-?mail|message|note|mail|nachricht|correo|courriel|mensaje)\b[^.]{0,60}(?:confidential|privileged|private information|vertraulich|confidencial|confidentiel)|(?:contents?|inhalt|contenu|contenido)[^.]{0,50}(?:e-?mail|message|nachricht|courriel|correo|mensaje)[^.]{0,40}(?:confiden|vertraulich)|attachments? may (?:hold|contain)",
        r"(?:meant|intended) (?:only|solely)|nur für den (?:empfänger|adressaten)|destiné au seul|va dirigido solo|exclusivement destiné|(?:únicamente|exclusivamente) (?:a|para)\b",
        r"reached you by mistake|received (?:this|it)[^.]{0,30}(?:in error|by mistake)|irrtümlich erh(?:ie|a)lten|(?:recib\w+)[^.]{0,20}por error|en cas d.erreur|reçu (?:ce|cet)[^.]{0,30}par erreur",
        r"anyone else must not|must not copy, forward|reading or passing it on|passing it on by others|durch dritte|par un tiers|por terceros|weitergabe|unbefugte|prohibid|interdit|diffusion|divulga|no debe copiar|ne doit (?:pas|ni)",
        r"(?:liability|liable|haften|haftung|responsab|répond)[^.]{0,40}vir(?:us|en)|vir(?:us|en)\b[^.]{0,30}(?:liab|haft|responsab|évent)|respond\w+ de daños|respondemos",
        r"before printing|vor dem (?:aus)?drucken|avant d.imprimer|antes de imprimir|think of the environment|an die umwelt",
        r"views (?:stated|expressed)|ansichten|meinungen? des (?:verfassers|absenders)|opinions?\b[^.]{0,40}(?:auteur|autor)|writer alone",
        r"binding offer|legally binding|rechtsverbindlich|(?:ver)?bindendes angebot|verbindliches angebot|offre ferme|oferta vinculante|no constituye oferta|ne vaut pas engagement",
        r"tell the sender and delete|delete (?:it|this (?:e-?mail|message))|löschen sie (?:sie|diese)|avise al remitente|avertir l.expéditeur|bórrelo",
    )
)

#: Weights: (cue -> label -> score).  A blank cue list leaves a block to the authored text.
PRIOR = (1.0, -1.5, -2.0, -2.0)
SWITCH = -0.6


#: Lines of a contact block.
CARD_LINES = 12


def _blocks(lines: list[str]) -> list[tuple[int, int]]:
    """[start, end) of blocks; blank lines belong to the block before them."""
    cuts, kind_before = [0], None
    for i, x in enumerate(lines):
        s = x.strip()
        marked = bool(s) and MARK.match(x) is not None
        kind = "m" if marked else "t"
        cue = bool(s) and not marked and (DASHES.match(s) or STARS.match(s) or RULE_LONG.match(s) or FORWARD.match(s) or CLOSING.match(s) or DEVICE.match(s) or CAUTION.match(s) or PIPES.match(s) or (s.endswith(":") and WROTE.match(s)))
        if i and s and (kind != kind_before or cue or not lines[i - 1].strip()):
            cuts.append(i)
        if s:
            kind_before = kind
    cuts = sorted(set(cuts))
    return list(zip(cuts, [*cuts[1:], len(lines)]))


def _near(name: list[str], local: str, s: str) -> bool:
    """Whether a line calls the sender: by the names, or by a word of the local part (jstone, stone_j)."""
    low = s.lower()
    if name and sum(p in low for p in name) >= min(2, len(name)):
        return True
    return len(low) <= 60 and any(w in local for w in re.findall(r"[^\W\d_]{4,}", low))


def _contact_runs(blocks: list[tuple[int, int]], lines: list[str], name: list[str], local: str) -> list[tuple[int, int]]:
    """Blocks with a contact block that blank lines tear apart put together: short lines in a row
    from one that calls the sender, or is a line of dashes, with a phone or an address among them."""
    short, called, contact = [], [], []
    for i, j in blocks:
        ls = [x for x in lines[i:j] if x.strip()]
        s = ls[0].strip() if ls else ""
        fine = bool(ls) and len(ls) <= 2 and all(len(x) <= 70 and not SENTENCE.search(x) and not MARK.match(x) and not HEADER.match(x) for x in ls)
        dashes = bool(s) and DASHES.match(s) is not None
        short.append(fine and not (CLOSING.match(s) or DEVICE.match(s) or FORWARD.match(s) or RULE_LONG.match(s) or CAUTION.match(s) or s[-1] in ",:" or (STARS.match(s) and not dashes)))
        called.append(fine and (dashes or any(_near(name, local, x) for x in ls)))
        contact.append(fine and any(CONTACT.match(x) or MAIL_ONLY.match(x) for x in ls))
    out, b, n = [], 0, len(blocks)
    while b < n:
        e = b
        if short[b] and called[b]:
            while e < n and short[e]:
                e += 1
        if e - b >= 3 and any(contact[b:e]):
            out.append((blocks[b][0], blocks[e - 1][1]))
            b = e
        else:
            out.append(blocks[b])
            b += 1
    return out


#: States of an open span: authored; quoted without a cue, with one inside its first block, with
#: one that opens it (first block, later blocks); signature by (contact seen, sender called);
#: disclaimer by legal cues seen.
_A, _Q, _Q_IN, _Q_OPEN, _Q_ON, _S, _D = 0, 1, 2, 3, 4, 5, 9
_LABEL = (AUTHORED, *[QUOTED] * 4, *[SIGNATURE] * 4, *[DISCLAIMER] * 3)
_BOTH, _LONGER, _RUNS_ON, _ANNOUNCED, _SEVERAL = 1.5, -0.8, 1.6, 2.5, 1.0


def _spans(emit: list, start: list, phone: list, called: list, legal: list, marked: list) -> list[tuple[int, int, int]]:
    """(label, first block, end) of the best sequence of spans."""
    n, least = len(emit), float("-inf")
    value = [least] * 12
    back: list[list[tuple[int, bool]]] = []
    for b in range(n):
        e, st = emit[b], start[b]
        new, via = [least] * 12, [(0, True)] * 12
        # Best end of a span of each label before this block.
        ends = [(0.0, -1)] * 4 if b == 0 else [max((value[s], s) for s in r) for r in ((0,), (1, 2, 3, 4), (5, 6, 7, 8), (9, 10, 11))]
        s_new = _S + 2 * bool(phone[b]) + bool(called[b])
        q_new = _Q_OPEN if st[QUOTED] > 0 else _Q_IN if e[QUOTED] > 3 else _Q
        d_new = _D + min(legal[b], 2)
        for s, bonus in ((_A, 0.0), (q_new, 0.0), (s_new, _BOTH if s_new == _S + 3 else 0.0), (d_new, _SEVERAL if d_new == _D + 2 else 0.0)):
            k = _LABEL[s]
            v, p = ends[0] if b == 0 else max(x for q, x in enumerate(ends) if q != k or k == QUOTED)
            new[s], via[s] = v + e[k] + st[k] + SWITCH + bonus, (p, True)
        if b:
            for s in range(12):
                v, k = value[s], _LABEL[s]
                if v == least:
                    continue
                to, v = s, v + e[k]
                if k == QUOTED:
                    if s == _Q_OPEN:
                        to, v = _Q_ON, v + (0.0 if marked[b] else _ANNOUNCED)
                    v += _RUNS_ON if s != _Q else 0.0
                elif k == SIGNATURE:
                    to = _S + ((s - _S) | (2 * bool(phone[b]) + bool(called[b])))
                    v += _LONGER + (_BOTH if to == _S + 3 != s else 0.0)
                elif k == DISCLAIMER:
                    to = _D + min(s - _D + legal[b], 2)
                    v += _SEVERAL if to == _D + 2 != s else 0.0
                if v > new[to]:
                    new[to], via[to] = v, (s, False)
        value = new
        back.append(via)
    out, b, s, end = [], n - 1, max(range(12), key=lambda s: value[s]), n
    while b >= 0:
        p, begins = back[b][s]
        if begins:
            out.append((_LABEL[s], b, end))
            end = b
        b, s = b - 1, p
    return out[::-1]


def decode(text: str | None) -> list[tuple[int, str]]:
    """(label, span text) of a mail in order; the mail's own head is no part of it."""
    if not text:
        return []
    m = TOP.match(text)
    head, body = (text[: m.end()], text[m.end() :]) if m else ("", text)
    lines = body.split("\n")
    # The sender's names: from the name in the head, else from the local part of the address.
    who = re.search(r"(?:From|Von|De)\s?:\s*([^\n]*)", head)
    line = who.group(1) if who else ""
    at = re.search(r"([\w.+-]+)@[\w.-]+", line)
    local = at.group(1).lower() if at else ""
    address = at.group(0).lower() if at else "\0"
    shown = re.split(r"[<(]|[\w.+-]+@", line)[0]
    name = [w for w in re.findall(r"[^\W\d_]{3,}", (shown if shown.strip() else local).lower())]
    blocks = _contact_runs(_blocks(lines), lines, name, local)
    if not blocks:
        return []
    long_lines = any(len(x) > 90 for x in lines)
    emit, start, phone, called, legal, marked = [], [], [], [], [], []
    for b, (i, j) in enumerate(blocks):
        ls = [x for x in lines[i:j] if x.strip()]
        joined = " ".join(x.strip() for x in ls)
        e, st = [0.0] * 4, [0.0] * 4
        first = ls[0].strip() if ls else ""
        two = " ".join(x.strip() for x in ls[:2])
        # Quotes: marks on most lines, an attribution, a forward line, or a block of head lines.
        marks = sum(1 for x in ls if MARK.match(x))
        numeric = len(ls) >= 1 and marks == 1 and len(ls) == 1 and NUMBER_AFTER.match(ls[0]) is not None
        if ls and marks * 2 > len(ls) and not numeric:
            e[QUOTED] += 8
            e[AUTHORED] -= 3
            e[SIGNATURE] -= 4
            e[DISCLAIMER] -= 4
        heads = sum(1 for x in ls if HEADER.match(x))
        if FORWARD.match(first) or (first and (WROTE.match(first) or (len(ls) > 1 and WROTE.match(two))) and re.search(r"\d|@", two)):
            st[QUOTED] += 7
            e[QUOTED] += 4
            e[SIGNATURE] -= 4
            e[DISCLAIMER] -= 4
        if heads >= 2:
            st[QUOTED] += 4
            e[QUOTED] += 5
            e[SIGNATURE] -= 3
        if RULE_LONG.match(first):
            nxt = [x for x in lines[i + 1 : i + 4] if x.strip()]
            if sum(1 for x in nxt if HEADER.match(x)) >= 2:
                st[QUOTED] += 5
                e[QUOTED] += 3
        # Signatures: a line of dashes, short lines with the sender's name, role and contacts.
        tail = ls[1:] if first and (DASHES.match(first) or STARS.match(first)) else ls
        if first and DASHES.match(first):
            st[SIGNATURE] += 1.5
        is_short = bool(tail) and len(tail) <= CARD_LINES and all(len(x) <= 70 and not SENTENCE.search(x) for x in tail)
        ph = any(CONTACT.match(x) for x in tail) or any(PIPES.match(x.strip()) and PHONE.search(x) for x in tail)
        ml = any(MAIL_ONLY.match(x) for x in tail)
        nm = any(_near(name, local, x) for x in tail[:2])
        if DEVICE.match(first) and len(ls) <= 2 and len(joined) <= 90:
            e[SIGNATURE] += 7
        elif is_short and marks == 0 and heads < 2:
            if ph:
                e[SIGNATURE] += 4.5
            if ml and len(tail) >= 2:
                e[SIGNATURE] += 4
                if any(address in x.lower() for x in tail):
                    e[SIGNATURE] += 2
            if nm and len(tail) >= 2:
                e[SIGNATURE] += 1.5
            if tail is not ls and (nm or ph or ml):
                e[SIGNATURE] += 2.5
        if tail and not is_short:
            e[SIGNATURE] -= 3
        if CLOSING.match(first):
            e[AUTHORED] += 2
            if nm and not (ph or ml):
                e[AUTHORED] += 2
        # Disclaimers: legal cues; a caution in brackets or a short line that names the mail.
        hits = sum(1 for rx in LEGAL if rx.search(joined)) if marks == 0 else 0
        if hits:
            e[DISCLAIMER] += 4.5 + 1.5 * (hits - 1)
            e[AUTHORED] -= 0.5 * (hits - 1)
        if len(ls) <= 2 and CAUTION.match(joined) and CAUTION_WORDS.search(joined) and (joined[:1] in "[(*" or joined.isupper()):
            e[DISCLAIMER] += 7
        if first and STARS.match(first) and hits:
            st[DISCLAIMER] += 1
        # Quoted text keeps the narrow lines of the program that quoted it.
        if long_lines and len(ls) >= 2 and max(map(len, ls)) <= 76 and marks == 0 and not is_short:
            e[QUOTED] += 1.5
        if len(joined) > 60 and marks == 0 and not hits and heads < 2:
            e[AUTHORED] += 1
        for k in range(4):
            e[k] += PRIOR[k]
        emit.append(e), start.append(st), phone.append(ph or ml), called.append(nm), legal.append(hits), marked.append(marks > 0)
    return [(k, "\n".join(lines[blocks[i][0] : blocks[j - 1][1]])) for k, i, j in _spans(emit, start, phone, called, legal, marked)]


def newly_written(text: str | None) -> str | None:
    """The text its sender newly wrote: authored spans without the mail's head."""
    if text is None:
        return None
    return "\n".join(s.strip("\n") for k, s in decode(text) if k == AUTHORED and s.strip()).strip()


def reduce_mails(mails: DataFrame) -> DataFrame:
    """(id, authored, quote, signature, disclaimer) of every row of mails (id, text).

    `authored` is the text newly written, the others tell whether the mail holds such spans.
    A null text gives null and no spans, an empty one an empty text.  Rows are independent, so
    repeated rows and ids, any order and an empty table need no care.
    """

    def make():
        def f(ids, texts):
            a, found = [], [[], [], []]
            for t in texts:
                spans = decode(t)
                a.append(None if t is None else "\n".join(s.strip("\n") for k, s in spans if k == AUTHORED and s.strip()).strip())
                for x, k in zip(found, (QUOTED, SIGNATURE, DISCLAIMER)):
                    x.append(any(k == q for q, _ in spans))
            return ids, a, *found

        return f

    return map_rows(mails, ["id", "text"], make, "id long, authored string, quote boolean, signature boolean, disclaimer boolean")
