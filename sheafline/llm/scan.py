"""Noise in text from scanned pages: running heads, page numbers, broken words, misread signs.

Running heads are short lines that recur, under a fold of look-alike signs, on other pages of
the same file.  Page numbers are lines (or ends of head lines) whose number continues a sequence
over the pages of the file; a number that stands alone in its file needs marks of its own
("- 7 -", "Page 7") or the edge of the page, and every other number belongs to the body.  What
remains is joined and checked with a vocabulary counted over the whole corpus: a break is a
hyphenation unless the hyphenated form is a word of its own, and a token is misread when it is no
word but undoing one or two look-alike confusions makes it one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows
from sheafline.session import cut

# Signs that scanners take for others (read -> meant).
CONFUSIONS = (
    ("c", "e"), ("!", "i"), ("@", "a"), ("f", "t"), ("0", "o"), ("cl", "d"), ("|", "l"), ("1", "l"), ("5", "s"), ("ii", "u"), ("ii", "ü"), ("9", "g"), ("b", "h"), ("rn", "m"),
    ("m", "in"), ("m", "rn"), ("h", "li"), ("vv", "w"), ("6", "é"), ("6", "b"), ("8", "b"), ("$", "s"), ("€", "e"), ("3", "e"), ("1", "i"), ("|", "i"),
)

HYPHENS = "-‐‑­¬"
#: These hyphens are never part of a written word.
SOFT = "­¬‐"
# Words after a hyphen that belongs to the text ("in- and outlet").
JOINERS = frozenset("and or to und oder bis sowie bzw et ou à y o u e ni".split())

_NUM = r"[\dOoIlSsBZz|!]"
_PAGE_TOKEN = (
    rf"(?:[—–−-]\s?(?:\d|{_NUM}{{1,4}}(?=[^\n]*\d)|{_NUM}{{1,3}}){_NUM}{{0,3}}\s?[—–−-]"
    rf"|[\[(]\s?{_NUM}{{1,4}}\s?[\])]"
    rf"|(?:P[aá@]g[ecia@]{{1,3}}|P[aá]gina|Pag[ce]|Seite|Se[i!]te|Seife|Scite|pág\.|p\.|pg\.|S\.)\s?{_NUM}{{1,4}}(?:\s?(?:/|of|von|de|sur)\s?{_NUM}{{1,4}})?"
    rf"|\d{_NUM}{{0,3}}\s?/\s?{_NUM}{{1,4}}"
    rf"|(?=[^\n]*\d){_NUM}{{1,4}}"
    rf"|(?:(?=[ivxlc])(?:c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}))"
    rf"|(?:(?=[IVXLC])(?:C{{0,3}})(?:XC|XL|L?X{{0,3}})(?:IX|IV|V?I{{0,3}})))"
)
PAGE_LINE = re.compile(rf"\s*{_PAGE_TOKEN}\s*\Z")
PAGE_LEFT = re.compile(rf"\s*({_PAGE_TOKEN})\s{{2,}}(?=\S)")
PAGE_RIGHT = re.compile(rf"(?<=\S)\s{{2,}}({_PAGE_TOKEN})\s*\Z")

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
TOKEN = re.compile(r"\S+")
#: Codes, paths, file names and comparisons are not words.
CODE = re.compile(r"[_\\/<>&+=#%]|^[A-Z]*\d[\w]*-[\w-]*$|^[\w]*\d-\w+$|^[A-Z]\w*\d\w*-\w+$|@\S+\.|^\W*\d[\d.,:%/-]*\W*$|^https?:|\.\w{2,4}$")

_FOLD_SIGNS = str.maketrans({"0": "o", "5": "s", "9": "g", "@": "a", "6": "e", "1": "l", "|": "l", "!": "i", "f": "t", "c": "e", "b": "h", "i": "i"})
_FOLD_PAIRS = (("in", "m"), ("ni", "m"), ("rn", "m"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("el", "d"))


def fold(line: str) -> str:
    """A line under the fold of look-alike signs, without blanks, signs and accents."""
    s = unicodedata.normalize("NFD", line.lower())
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(_FOLD_SIGNS)
    s = re.sub(r"[^a-z0-9]", "", s)
    for a, b in _FOLD_PAIRS:
        s = s.replace(a, b)
    return s


#: Lines with a page number at one end hold at most so many other signs; a running head is no longer either.
HEAD_SIGNS = 160


def page_token(line: str) -> tuple[str | None, str]:
    """(what may be a page number, the rest of the line)."""
    if not line.strip():
        return None, ""
    if PAGE_LINE.match(line):
        return line.strip(), ""
    m = PAGE_LEFT.match(line)
    if m and len(line) - m.end() <= HEAD_SIGNS:
        return m.group(1), line[m.end() :].strip()
    m = PAGE_RIGHT.search(line)
    if m and m.start() <= HEAD_SIGNS:
        return m.group(1), line[: m.start()].strip()
    return None, line.strip()


def page_parts(line: str) -> tuple[bool, str]:
    """(may hold a page number, the rest of the line)."""
    token, rest = page_token(line)
    return token is not None, rest


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_AS_DIGIT = str.maketrans("OoIlSsBZz|!", "00115582211")
#: Forms that are marked as page numbers; the others (plain, ratio, roman) are only numbers.
MARKED = ("dash", "bracket", "word")


def page_value(token: str) -> tuple[str, int]:
    """(form, number) of a page number: 'dash', 'bracket', 'word', 'ratio', 'plain' or 'roman'."""
    t = token.strip()
    if t[0] in "—–−-":
        form = "dash"
    elif t[0] in "[(":
        form = "bracket"
    elif not any(c.isdigit() for c in t) and all(c.lower() in _ROMAN for c in t) and (t.islower() or t.isupper()) and t not in ("l", "I"):
        v = [_ROMAN[c] for c in t.lower()]
        return "roman", sum(-x if y > x else x for x, y in zip(v, [*v[1:], 0]))
    elif t[0].isalpha() and not re.match(_NUM, t):
        form = "word"
    elif re.match(r"[Ss](?:e[i!]t|[c.])", t):
        form = "word"
    else:
        form = "ratio" if "/" in t else "plain"
    m = re.search(rf"(?<![^\W\d_]){_NUM}{{1,4}}(?![^\W\d_])", t if form != "word" else re.sub(r"\A[^\s.\d]+[.\s]?", " ", t))
    return form, int(m.group(0).translate(_AS_DIGIT)) if m else -1


def page_spots(lines: list[str]) -> list[tuple[int, str, int, bool]]:
    """(line number, form, number, stands apart) of possible page numbers.

    A line stands apart at the edge of the text where no sentence runs on over it: after a blank
    line or the end of a sentence, or before a blank line or the start of one.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = []
    for at, i in enumerate(full):
        token, rest = page_token(lines[i])
        if token is None:
            continue
        apart = False
        if not rest and at == len(full) - 1:
            apart = at == 0 or full[at - 1] < i - 1 or lines[full[at - 1]].rstrip()[-1] in ".!?:"
        if not rest and at == 0 and len(full) > 1:
            nxt = lines[full[1]].lstrip()[0]
            apart = full[1] > i + 1 or nxt.isupper() or not nxt.isalpha()
        out.append((i, *page_value(token), apart))
    return out


def head_candidates(text: str) -> list[tuple[int, list[str]]]:
    """(line number, keys) of the lines that may be running heads."""
    parts = [page_parts(x) for x in text.split("\n")]
    body = [i for i, (_, rest) in enumerate(parts) if rest]
    out = []
    for at, i in enumerate(body):
        page, line = parts[i]
        if len(line) > HEAD_SIGNS or line[-1] in ".,;:?!" + HYPHENS and not re.search(r"\s{2,}|\s[–—/|·]\s", line):
            continue
        if not re.search(r"[^\W\d_]{3}", line) or line[0] in "-*•>|#":
            continue
        up = line[0].isupper() or not line[0].isalpha()
        framed = re.search(r"\s{3,}|\s[–—/|·]\s", line) is not None or page
        first, last = at == 0, at == len(body) - 1
        nxt = parts[body[at + 1]][1] if not last else ""
        prv = parts[body[at - 1]][1] if not first else ""
        alone_above = i == 0 or not text.split("\n", i + 1)[i - 1].strip()
        alone_below = i + 1 >= len(parts) or not parts[i + 1][1] and not parts[i + 1][0]
        edge = (first and (alone_below or nxt[:1].isupper() or not nxt[:1].isalpha())) or (last and (alone_above or prv[-1:] in ".!?" or up))
        inside = up and prv and prv[-1] not in ".!?:" and bool(nxt) and (nxt[0].islower() or framed)
        if not (framed or edge or inside or (alone_above and alone_below)):
            continue
        key = fold(line)
        if len(key) < 5:
            continue
        words = [w for w in re.split(r"\s+", line) if w]
        keys = [key]
        if len(words) >= 4:
            keys += ["~" + fold(" ".join(words[:k] + words[k + 1 :])) for k in range(len(words))]
            keys = [k for k in keys if len(k) >= 12 or k is key]
        out.append((i, list(dict.fromkeys(keys))))
    return out


#: How far a printed number may be from the page it stands on (unnumbered leaves before it).
SHIFT = 2
#: Chunks and numbers that a sequence may skip: cells of the grid in which numbers are compared.
NEAR_ORD, NEAR_PAGE = 16, 64


def _in_sequence(spots: DataFrame) -> DataFrame:
    """(file_id, form, ord, value) of the numbers that another page of the file continues.

    Distinct numbers lie in cells of NEAR_ORD chunks and NEAR_PAGE pages, so however long a file
    is, a cell holds a bounded number of them, and a number meets only its own cell and the next.
    """
    one = spots.where("ord is not null and value >= 0").select("file_id", "form", "ord", "value").distinct()
    cell = lambda c, n: F.floor(F.col(c) / n)
    a = one.withColumn("_o", cell("ord", NEAR_ORD)).withColumn("_v", cell("value", NEAR_PAGE))
    around = F.explode(F.array(*[F.struct((cell("ord", NEAR_ORD) + i).alias("o"), (cell("value", NEAR_PAGE) + j).alias("v")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = one.select("file_id", "form", F.col("ord").alias("ord_b"), F.col("value").alias("value_b"), around.alias("c")).select("file_id", "form", "ord_b", "value_b", F.col("c.o").alias("_o"), F.col("c.v").alias("_v"))
    steps, pages = F.col("ord_b") - F.col("ord"), F.col("value_b") - F.col("value")
    fits = (F.signum(steps) == F.signum(pages)) & (steps != 0) & (F.abs(pages) * 2 >= F.abs(steps)) & (F.abs(pages) <= 3 * F.abs(steps) + 2)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "file_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("file_id", "form", "_o", "_v")]
    on = same[0] & same[1] & same[2] & same[3]
    return a.alias("a").join(b.alias("b"), on & fits, "left_semi").select("file_id", "form", "ord", "value")


def marks(pages: DataFrame) -> DataFrame:
    """(id, head_lines, page_lines) of pages (id, file_id, ord, page, text) with running heads or page numbers.

    Keys of heads are counted per file with partial sums; no page of a file is compared with
    another one.  Numbers of one form are compared along the file (`_in_sequence`), and with
    the page that the text was read from, where that is known (page).  A number outside of any
    sequence is a page number only where its form has no sequence in the file: if it is marked
    as one, or if its line stands apart at the edge of the page.
    """

    def make():
        def f(ids, files, ords, nos, texts):
            out = [[] for _ in range(9)]
            for i, g, o, n, t in zip(ids, files, ords, nos, texts):
                t = t or ""
                for line, keys in head_candidates(t):
                    for k in keys:
                        for c, v in zip(out, (i, g, o, line, k, None, None, None, None)):
                            c.append(v)
                for line, form, value, edge in page_spots(t.split("\n")):
                    for c, v in zip(out, (i, g, o, line, None, form, value, edge, n is not None and abs(n - value) <= SHIFT)):
                        c.append(v)
            return out

        return f

    c = cut(map_rows(pages, ["id", "file_id", "ord", "page", "text"], make, "id long, file_id long, ord long, line int, key string, form string, value long, edge boolean, placed boolean"))
    keyed = c.where("key is not null").select("id", "file_id", "line", "key")
    seen = keyed.groupBy("file_id", "key").agg((F.min("id") != F.max("id")).alias("again")).where("again").drop("again")
    heads_ = keyed.join(seen, ["file_id", "key"], "left_semi").select("id", "line").distinct()
    spots = c.where("form is not null").drop("key")
    runs = cut(_in_sequence(spots))
    forms = runs.select("file_id", "form").distinct().withColumn("_other", F.lit(True))
    s, r, o = spots.alias("s"), runs.withColumn("_run", F.lit(True)).alias("r"), forms.alias("o")
    file_ = lambda t: F.col("s.file_id").eqNullSafe(F.col(f"{t}.file_id")) & (F.col("s.form") == F.col(f"{t}.form"))
    j = s.join(r, file_("r") & (F.col("s.ord") == F.col("r.ord")) & (F.col("s.value") == F.col("r.value")), "left").join(o, file_("o"), "left").select("s.id", "s.line", "s.form", "s.edge", "s.placed", "_run", "_other")
    # A number beside a running head is its page number.
    j = j.join(heads_.withColumn("_head", F.lit(True)), ["id", "line"], "left")
    taken = F.col("placed") | F.col("_run").isNotNull() | F.col("_head").isNotNull() | (F.col("_other").isNull() & (F.col("form").isin(*MARKED) | F.col("edge")))
    both = heads_.select("id", F.col("line").alias("h"), F.lit(None).cast("int").alias("p")).unionByName(j.where(taken).select("id", F.lit(None).cast("int").alias("h"), F.col("line").alias("p")))
    return both.groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("head_lines"), F.sort_array(F.collect_set("p")).alias("page_lines"))


def vocabulary(clean: DataFrame, pages: DataFrame) -> DataFrame:
    """(word, n, m): counts of every word in clean texts and in scanned pages, lower case."""

    def counts(df: DataFrame) -> DataFrame:
        def make():
            def f(texts):
                # Words never span blanks: the pieces between them are counted, and only distinct ones cut into words.
                pieces: Counter = Counter()
                for t in texts:
                    if t:
                        pieces.update(t.lower().split())
                c: Counter = Counter()
                for p, k in pieces.items():
                    for w in WORD.findall(p):
                        c[w] += k
                return list(c), list(c.values())

            return f

        return map_rows(df, ["text"], make, "word string, n long")

    both = counts(clean).withColumn("m", F.lit(0).cast("long")).unionByName(counts(pages).select("word", F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    whole = both.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    # Parts of hyphenated words count as words too.
    parts = whole.where(F.col("word").contains("-")).select(F.explode(F.split("word", "-")).alias("word"), "n", "m")
    return whole.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


#: Tokens of more signs are no words (links, tables without blanks) and are not corrected.
WORD_SIGNS = 200


def corrections(token: str) -> set[str]:
    """Words a misread token may stand for: one or two confusions undone."""
    if len(token) > WORD_SIGNS:
        return set()
    once: set[tuple[str, int]] = set()

    def undo(s: str, start: int) -> set[tuple[str, int]]:
        out = set()
        for a, b in CONFUSIONS:
            k = s.find(a, start)
            while k >= 0:
                out.add((s[:k] + b + s[k + len(a) :], k + len(b)))
                k = s.find(a, k + 1)
        return out

    once = undo(token, 0)
    found = {s for s, _ in once}
    for s, k in once:
        found.update(x for x, _ in undo(s, k))
    signs = [s for s in found if s.isalpha()]
    return set(signs) - {token}


def _tokens(line: str):
    """(token, start, end) of the parts of words of a line; apostrophes and hyphens split."""
    for m in TOKEN.finditer(line):
        raw = m.group(0)
        if CODE.search(raw.strip(".,;:()[]\"'“”„«»?")):
            continue
        a = m.start()
        for p in re.finditer(r"[^'’\-–—‐­¬]+", raw):
            s = p.group(0)
            left = len(s) - len(s.lstrip(".,;:()[]\"“”„«»?*"))
            t = s.strip(".,;:()[]\"“”„«»?*")
            if t and re.search(r"[^\W\d_]", t):
                yield t, a + p.start() + left, a + p.start() + left + len(t)


#: The most frequent words go to every task, so that only the rest has to be looked up.
FREQUENT = 50_000
EVENTS = "id long, kind string, a string, b string"


#: Bits of the map of all words that stand twice in clean texts; a full map only costs time.
WORD_BITS = 1 << 24


def word_map(vocab: DataFrame) -> bytes:
    """A bit for the hash of each word with n >= 2: what has no bit is no such word."""
    h = vocab.where("n >= 2").select(F.crc32(F.encode("word", "UTF-8")).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int").alias("h")).distinct().toArrow()
    bits = np.zeros(WORD_BITS, bool)
    bits[h.column(0).to_numpy()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _maybe(word: str, words: bytes) -> bool:
    h = crc32(word.encode("utf-8", "surrogatepass")) & (WORD_BITS - 1)
    return bool(words[h >> 3] >> (h & 7) & 1)


def line_break(line: str, after: str) -> tuple[str, str, str, str | None] | None:
    """(left half, right half, joined, hyphenated) of a word that the end of a line breaks, else
    None; hyphenated is None where the hyphen is a sign that no word is written with."""
    if not line or line[-1] not in HYPHENS:
        return None
    m, n = re.search(r"([^\W_]*[^\W\d_])[" + HYPHENS + r"]\Z", line), re.match(r"\s*(\S+)", after)
    if not m or not n:
        return None
    left, right = m.group(1), n.group(1).strip(".,;:()[]\"“”„«»?!")
    if not right or not right[0].isalpha() and right[0] not in "!|1@0569$" or right.split("'")[0].lower() in JOINERS:
        return None
    if not right[0].islower() and right[0].isalpha() and not line.isupper():
        return None
    before = re.search(r"(\S*)[" + HYPHENS + r"]\Z", line).group(1)
    kept = (re.sub(r"^\W+", "", before) + "-" + right).lower()
    return left, right, (left + right).lower(), None if line[-1] in SOFT else kept


def body_lines(text: str, head_lines, page_lines) -> list[str]:
    """The lines of a page without running heads and page numbers; blank lines stay as ''."""
    heads_at, pages_at, out = set(head_lines or ()), set(page_lines or ()), []
    for i, x in enumerate(text.split("\n")):
        if i in heads_at:
            continue
        rest = page_token(x)[1] if i in pages_at else x.rstrip(" \t")
        if rest.strip() or i not in pages_at:
            out.append(rest if rest.strip() else "")
    return out


def _events(text: str, head_lines, page_lines, frequent: set, safe: set, words: bytes) -> list[tuple[str, str | None, str | None]]:
    """What a page shows: ('page'|'header'|'hyphen', ..), words to look up ('token'), possible
    splits ('pair') and breaks whose hyphen may belong to the text ('break')."""
    out: list[tuple[str, str | None, str | None]] = []
    out += [("page", None, None)] if page_lines else []
    out += [("header", None, None)] if head_lines else []
    body = [x for x in body_lines(text, head_lines, page_lines) if x]
    skip: dict[int, int] = {}
    for k, x in enumerate(body[:-1]):
        got = line_break(x, body[k + 1])
        if got:
            left, right, joined, kept = got
            skip[k] = len(right)
            whole = (left + right.split("'")[0].split("’")[0]).lower()
            if whole not in safe:
                out.append(("token", whole, None))  # a broken word may be misread as well
            out.append(("hyphen", None, None) if kept is None else ("break", joined, kept))
    last = None  # the last word of the line before, which a line end may have cut off
    for k, x in enumerate(body):
        toks = list(_tokens(x))
        if k in skip and toks:
            toks = toks[:-1]
        if k - 1 in skip and toks:
            toks = toks[1:]
        prev = last if k - 1 not in skip else None
        last = None
        for t, a, b in toks:
            low = t.lower()
            if low not in safe:
                bare = low.strip("!|")
                if bare == low or "|" in low or bare not in frequent:
                    out.append(("token", low, None))
            near = prev is not None and (a == prev[2] + 1 and x[prev[2]] == " " if prev[2] >= 0 else not x[:a].strip())
            if near and prev[0].isalpha() and t.isalpha():
                pl = prev[0].lower()
                if x[b : b + 1] in ("'", "’"):
                    pass  # an elided article, not half a word
                elif _maybe(pl + low, words):
                    if not (t[0].isupper() and not prev[0].isupper()):
                        out.append(("pair", pl, low))
            prev = (t, a, b)
        if prev is not None and toks and k not in skip and not x[prev[2] :].strip():
            last = (prev[0], -1, -1)
    return list(dict.fromkeys(out))


def events(pages: DataFrame, marked: DataFrame, frequent: list[str], odd: list[str], words: bytes) -> DataFrame:
    """`odd` are those of the frequent words that the vocabulary may call misread."""
    known = set(frequent)
    safe = known - set(odd)
    j = pages.join(marked, "id", "left")

    def make():
        def f(ids, texts, hs, ps):
            a, b, c, d = [], [], [], []
            for i, t, h, p in zip(ids, texts, hs, ps):
                for k, x, y in _events(t or "", h, p, known, safe, words):
                    a.append(i), b.append(k), c.append(x), d.append(y)
            return a, b, c, d

        return f

    return map_rows(j, ["id", "text", "head_lines", "page_lines"], make, EVENTS)


#: A correction must be a word this much more frequent than what was read.
RARER = 50
#: A split pair must be this much rarer on scanned pages than the word it makes.
SPLIT_RARER = 4


def misreadings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, fix) of the tokens (token, own) that a far more frequent word explains."""

    def make():
        def f(tokens, own):
            a, b, c = [], [], []
            for t, n in zip(tokens, own):
                for s in corrections(t):
                    a.append(t), b.append(n), c.append(s)
            return a, b, c

        return f

    tries = map_rows(tokens, ["token", "own"], make, "token string, own long, word string")
    best = tries.join(words, "word").where((F.col("n") >= 2) & (F.col("n") >= RARER * F.col("own"))).groupBy("token").agg(F.max(F.struct("n", "word")).alias("w"))
    return best.select("token", F.col("w.word").alias("fix"))


def _pages(pages: DataFrame) -> DataFrame:
    """(id, file_id, ord, page, text), cut: the texts are read several times."""
    at = [(F.col(c).cast("long") if c in pages.columns else F.lit(None).cast("long")).alias(c) for c in ("ord", "page")]
    return cut(pages.select("id", "file_id", *at, "text"))


def _analysed(pages: DataFrame, marked: DataFrame, clean: DataFrame, frequent: int) -> DataFrame:
    """(id, defect, a, b, fix) of cut pages; 'kept' are breaks whose hyphen belongs to the word (a)."""
    clean = clean.select("text")
    vocab = cut(vocabulary(clean, pages))
    # At most `frequent` words, whatever the size of the corpus; ties go by the word.
    # They only save lookups: those that may be misread themselves are looked up like the rest.
    most = cut(vocab.where("n >= 2").orderBy(F.desc("n"), "word").select(F.col("word").alias("token"), F.col("n").alias("own")).limit(frequent))
    top = [r.token for r in most.select("token").collect()]
    words = vocab.select("word", "n", "m")
    doubted = [r.token for r in misreadings(most, words).select("token").collect()]
    ev = cut(events(pages.where("text is not null"), marked, top, doubted, word_map(vocab)))
    sure = ev.where(F.col("kind").isin("page", "header", "hyphen")).select("id", F.col("kind").alias("defect"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("fix"))

    # Breaks: the hyphen belongs to the text where the hyphenated form is a word and the joined one is not.
    br = ev.where("kind = 'break'").select("id", "a", "b")
    forms = br.select(F.explode(F.array("a", "b")).alias("word")).distinct().join(words, "word").select("word", F.col("n").alias("c"))
    br = br.join(forms.select(F.col("word").alias("a"), F.col("c").alias("joined")), "a", "left").join(forms.select(F.col("word").alias("b"), F.col("c").alias("kept")), "b", "left")
    own = F.coalesce("kept", F.lit(0)) > F.coalesce("joined", F.lit(0))
    hyphen = br.select("id", F.when(own, "kept").otherwise("hyphen").alias("defect"), F.when(own, F.col("b")).alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("fix"))

    # Misread tokens: each distinct one is looked up once.
    tok = ev.where("kind = 'token'").select("id", F.col("a").alias("token"))
    odd = tok.select("token").distinct().join(words.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").fillna({"own": 0})
    # A word with an exclamation mark is read as it stands, however rare the word is.
    marked = odd.where("token like '%!%' and not contains(token, '|')").select("token", F.expr("trim(both '!' from token)").alias("word")).where("word <> token")
    odd = odd.join(marked.join(words.where("n >= 2"), "word").select("token"), "token", "left_anti")
    misread = tok.join(misreadings(odd, words), "token").select("id", F.lit("chars").alias("defect"), F.col("token").alias("a"), F.lit(None).cast("string").alias("b"), "fix")

    # Split words: the halves make a word, and one half is none or the pair is rare against the word.
    pr = ev.where("kind = 'pair'").select("id", "a", "b", F.concat("a", "b").alias("word"))
    kinds = pr.groupBy("a", "b", "word").agg(F.countDistinct("id").alias("pages")).join(words.where("n >= 2"), "word")
    own = words.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    kinds = kinds.join(own.select(F.col("_w").alias("a"), F.col("_n").alias("na")), "a", "left").join(own.select(F.col("_w").alias("b"), F.col("_n").alias("nb")), "b", "left").fillna({"na": 0, "nb": 0})
    split = kinds.where((F.col("na") * RARER <= F.col("n")) | (F.col("nb") * RARER <= F.col("n")) | (F.col("pages") * SPLIT_RARER <= F.col("m"))).select("a", "b", F.col("word").alias("fix"))
    halves = pr.join(split, ["a", "b"]).select("id", F.lit("chars").alias("defect"), "a", "b", "fix")
    return sure.unionByName(hyphen).unionByName(misread).unionByName(halves)


def findings(pages: DataFrame, clean: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(id, defect, a, b, fix): every defect of every scanned page.

    pages: (id, file_id, text) of scanned files and, where known, their order in the file (ord) and
    the page that they were read from (page); clean: (text) of the rest of the corpus, whose words make the vocabulary (without any, misread
    signs cannot be told and are not reported).
    defect is 'page', 'header', 'hyphen' or 'chars'; a, b and fix tell a misread token, or the
    two halves of a split word, and the word meant.  Null and empty texts have no defects; a
    page that stands alone in its file has no running head; without ord and page no number
    continues a sequence; repeated ids are one page.
    """
    pages = _pages(pages)
    return _analysed(pages, marks(pages), clean, frequent).where("defect <> 'kept'")


def repair_text(text: str, head_lines, page_lines, fixes: dict) -> str:
    """Continuous paragraphs: heads and page numbers out, breaks joined, misread words put right.

    fixes: (token, None) or (half, half) to the word meant; ("kept", form) for breaks whose hyphen
    stays.
    """
    out, open_par, before = [], "", ""

    def cased(new: str, old: str) -> str:
        return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new

    paragraphs: list[str] = []
    for x in body_lines(text, head_lines, page_lines):
        line = x.strip()
        if not line:
            if open_par and open_par[-1] in ".!?:":
                paragraphs.append(open_par)
                open_par = ""
            continue
        got = line_break(before, line) if open_par else None
        if got and not (got[3] is not None and ("kept", got[3]) in fixes):
            open_par = open_par[:-1] + line
        elif got or open_par and open_par[-1] in HYPHENS and not open_par[-2:-1].isspace() and line[:1].isalnum() and line.split(" ")[0].lower().strip(".,") not in JOINERS:
            open_par += line  # the hyphen stays
        else:
            open_par = open_par + " " + line if open_par else line
        before = x.rstrip()
    if open_par:
        paragraphs.append(open_par)
    for p in paragraphs:
        parts, last = [], 0
        toks = list(_tokens(p))
        for k, (t, a, b) in enumerate(toks):
            if a < last:
                continue
            if k + 1 < len(toks):
                u, c, d = toks[k + 1]
                w = fixes.get((t.lower(), u.lower()))
                if w and c == b + 1 and p[b] == " ":
                    parts += [p[last:a], cased(w, t)]
                    last = d
                    continue
            w = fixes.get((t.lower(), None))
            if w:
                parts += [p[last:a], cased(w, t)]
                last = b
        out.append("".join(parts) + p[last:])
    return "\n\n".join(out)


def repair(pages: DataFrame, clean: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(id, repaired) of every scanned page; null stays null, an empty text stays empty."""
    pages = _pages(pages)
    marked = cut(marks(pages))
    f = _analysed(pages, marked, clean, frequent).where("defect in ('chars', 'kept')").groupBy("id").agg(F.collect_set(F.struct("defect", "a", "b", "fix")).alias("fixes"))
    j = pages.join(marked, "id", "left").join(f, "id", "left")

    def make():
        def g(ids, texts, hs, ps, fx):
            out = []
            for t, h, p, f in zip(texts, hs, ps, fx):
                fixes = {("kept", x["a"]) if x["defect"] == "kept" else (x["a"], x["b"]): x["fix"] for x in (f or ())}
                out.append(None if t is None else repair_text(t, h, p, fixes))
            return ids, out

        return g

    return map_rows(j, ["id", "text", "head_lines", "page_lines", "fixes"], make, "id long, repaired string")
