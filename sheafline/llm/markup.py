"""Markup residue in text: HTML, Markdown, wiki and LaTeX to clean text.

Pages of one host share a frame.  Each page's HTML containers are scored (own text against link
text), the hosts vote on generalised tag-class paths in Spark, and the text is extracted again
from the paths that win as content: containers on a path that the host's pages agree is a frame
of links are left out.  All other markup is converted piece by piece; headings, lists, tables,
code and formulas keep a plain form.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows
from sheafline.session import cut

# Names of HTML tags, of attributes without a value, and of character entities.
TAGS = "a abbr address article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta meter nav noscript object ol optgroup option output p param picture pre progress q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr nowiki gallery syntaxhighlight"
BARE_ATTRIBUTES = "checked disabled selected hidden readonly required multiple nowrap noshade compact defer async open controls loop muted autofocus"
VOID_TAGS = "br hr img input link meta wbr col base embed param source track"
CONTAINERS = "div section article main aside nav header footer ul ol table form td body"

_ATTR = r"""(?:\s+(?:[a-zA-Z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+)|(?:%s)(?=[\s/>])))*""" % "|".join(BARE_ATTRIBUTES.split())
TAG = re.compile(r"<(/?)(%s)(%s)\s*(/?)>" % ("|".join(sorted(TAGS.split(), key=len, reverse=True)), _ATTR), re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>", re.S | re.I)
DROPPED = re.compile(r"<(script|style|noscript|svg|template)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")
CLASS = re.compile(r"""class\s*=\s*["']?([^"'\s>]+)""", re.I)

FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)[ \t]*$", re.M)
INLINE_CODE = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
IMAGE = re.compile(r"!\[([^\[\]]*)\]\(([^()\s]*)(?:\s+\"[^\"]*\")?\)")
LINK = re.compile(r"(?<!!)\[([^\[\]]+)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)")
REF_LINK = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
REF_DEF = re.compile(r"^[ \t]{0,3}\[([^\[\]\n^]+)\]:[ \t]*<?(?:https?:|www\.|/|\w+[/.]\w)\S*.*$", re.M)
FOOTNOTE = re.compile(r"\[\^[\w-]+\]:?")
ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?=[^\n]*\w)([^\n]+)\n[ \t]{0,3}(={3,}|-{3,})[ \t]*$", re.M)
RULE_BELOW = re.compile(r"\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*(?:\n|\Z)")
TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)
TABLE_ROW = re.compile(r"^[ \t]*\|(?![-}])(.*)\|[ \t]*$", re.M)
STRONG = re.compile(r"(?<![\w*])(\*{2,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])")
EMPH = re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])")
UNDER = re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]*(?:\w_\w[^_\n]*)*[^\s_])\1(?![\w_])")
STRIKE = re.compile(r"~~(?=\S)([^~\n]*\S)~~")
TASK = re.compile(r"^([ \t]*(?:[-*+]|\d+[.)])[ \t]+)\[([ xX])\][ \t]+", re.M)
#: A quoted paragraph; a "greater than" sign before a number that a line break put first is none.
BLOCKQUOTE = re.compile(r"^[ \t]{0,3}>[ \t]?(?=[^\s\d=])", re.M)

WIKI_LINK = re.compile(r"\[\[([^\[\]\n]*)\]\]")
EXT_LINK = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+([^\[\]\n]+))?\]")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
WIKI_HEAD = re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
WIKI_QUOTES = re.compile(r"'{2,5}(?=[^'\s])([^'\n]*(?:'[^'\n]+)*[^'\s])'{2,5}")
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|.*|\|\}.*|\|-+[ \t]*(?:\w+[ \t]*=.*)?)$", re.M)
WIKI_CELL = re.compile(r"^[ \t]*[!|](?![|}-])[ \t]*(.*)$", re.M)
DOUBLE_BAR = re.compile(r"^[ \t]*\|\|(.+?)\|\|[ \t]*$", re.M)
BRACE_MACRO = re.compile(r"\{(code|noformat|quote|panel|info|note|warning|tip|color|toc)(?::[^{}\n]*)?\}")
H_DOT = re.compile(r"^[ \t]*h([1-6])\.[ \t]+(\S.*)$", re.M)
MAGIC = re.compile(r"__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__")

DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
PAREN_MATH = re.compile(r"\\\((.+?)\\\)", re.S)
DOLLAR_MATH = re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*?(?:[\\^_={}][^$\n]*?)|[A-Za-z])(?<=[^\s$])\$(?![\w$])")
ENVIRON = re.compile(r"\\(begin|end)[ \t]*\{([\w*]+)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?")
TEX_ITEM = re.compile(r"^[ \t]*\\item\b[ \t]*(?:\[([^\[\]\n]*)\])?[ \t]*", re.M)
TEX_HEAD = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?[ \t]*\{([^{}\n]*)\}")
TEX_NOTE = re.compile(r"~?\\(cite|citep|citet|ref|eqref|label|footnote|footnotemark|index|autoref|pageref|bibliography|bibliographystyle|usepackage|documentclass|input|include|vspace|hspace)\*?(?:\[[^\[\]\n]*\])*\{([^{}\n]*)\}")
TEX_STYLE = re.compile(r"\\([a-zA-Z]+)\*?(?:\[[^\[\]\n]*\])*\{([^{}\n]*)\}")
TEX_BARE = re.compile(r"(?<![\w:\\])\\(maketitle|tableofcontents|noindent|par|newline|newpage|clearpage|centering|hline|toprule|midrule|bottomrule|item|bigskip|medskip|smallskip|LaTeX|TeX|ldots|dots|quad|qquad|today|bf|it|em|tt|sc|small|large|Large|footnotesize)\b(?![\\])[ \t]*")
TEX_ESCAPE = re.compile(r"(?<![\w:\\])\\([%&#_{}$])|(?<=\d)\\([%&#$])")
TEX_BREAK = re.compile(r"\\\\(?=\s|$)")
TEX_COMMENT = re.compile(r"(?<![\\\w%])%%+[^\n]*$", re.M)

#: Lines of a mail that may look like markup and are none: its rules of signs.
MAIL_START = re.compile(r"\A\s*(?:From|Von|De|Para|To|An|Subject|Betreff|Asunto|Objet|Date|Datum|Fecha)\s*:", re.I)
#: A text without any of these characters holds no markup at all.
ANY_SIGN = r"[`{]|<[A-Za-z/!?]|&[A-Za-z#][A-Za-z0-9]*;|\*[^\s*]|\][\[(:]|\[\[|\[\^|\[[ xX]\]|\[(?:https?|ftp):|\\[A-Za-z(\[\\%&#_{}$]|\$[^\s\d]|\$\d[^$\n]*[\\^_={}]|~~|''|(?:^|[^\w_])_[^\s]|(?:^|\n)[ \t]*(?:[|!=>]|#{1,6}[ \t]|h[1-6]\.[ \t]|[-=]{3,}[ \t]*(?:\n|$)|:?-{2,}:?[ \t]*\|)|__(?:NO|FORCE)?TOC__|__NOEDITSECTION__"
_ANY = re.compile(ANY_SIGN)

KINDS = ("html", "markdown", "wiki", "latex")


def containers(text: str) -> list[tuple[str, int, int, int, int]]:
    """(generalised path, start, end, own text, link text) of each HTML container, in the order
    they close.  Digits in classes are generalised to '#'; open tags at the end close there."""
    out, stack, last, in_link = [], [], 0, 0
    void, cont = set(VOID_TAGS.split()), set(CONTAINERS.split())
    for m in TAG.finditer(text):
        n = len(text[last : m.start()].strip())
        for s in stack:
            s[2] += n
            s[3] += n if in_link else 0
        last = m.end()
        tag = m.group(2).lower()
        if tag == "a":
            in_link = 0 if m.group(1) else 1
        if tag not in cont or tag in void or m.group(4):
            continue
        if not m.group(1):
            k = CLASS.search(m.group(3) or "")
            up = stack[-1][0] + "/" if stack else ""
            stack.append([up + tag + ("." + re.sub(r"\d+", "#", k.group(1)) if k else ""), m.start(), 0, 0, tag])
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][4] == tag:
                    out += [(s[0], s[1], m.end(), s[2], s[3]) for s in reversed(stack[i:])]
                    del stack[i:]
                    break
    n = len(text[last:].strip())
    out += [(s[0], s[1], len(text), s[2] + n, s[3] + (n if in_link else 0)) for s in reversed(stack)]
    return out


def convert(text: str | None, frames: frozenset[str] | set[str] = frozenset()) -> tuple[str | None, tuple[int, int, int, int]]:
    """(clean text, pieces of html, markdown, wiki, latex).

    `frames` are container paths to leave out.  Null gives null, an empty text stays empty, and
    a text without markup is returned as it is.
    """
    if not text or not _ANY.search(text):
        return text, (0, 0, 0, 0)
    n = [0, 0, 0, 0]
    mail = MAIL_START.match(text) is not None
    t = text

    def sub(rx: re.Pattern, to: str | Callable, kind: int) -> None:
        nonlocal t
        t, k = rx.subn(to, t)
        n[kind] += k

    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    if frames and "<" in t:
        spans = sorted((a, b) for path, a, b, _, _ in containers(t) if path in frames)
        n[0] += len(spans)
        # Frames within frames go with the outermost one, so that no offset is stale.
        outer: list[list[int]] = []
        for a, b in spans:
            if outer and a < outer[-1][1]:
                outer[-1][1] = max(outer[-1][1], b)
            else:
                outer.append([a, b])
        for a, b in reversed(outer):
            t = t[:a] + "\n" + t[b:]
    # Code and formulas first: nothing inside them is markup of the text.
    if "```" in t or "~~~" in t:
        parts, open_at = [], None
        lines = t.split("\n")
        for i, line in enumerate(lines):
            m = FENCE.match(line)
            if m and open_at is None:
                open_at, body, lang = m.group(1)[0], [], m.group(2)
                n[1] += 1
            elif m and m.group(1)[0] == open_at:
                parts.append(keep("\n".join("    " + x for x in body)))
                open_at = None
            elif open_at is not None:
                body.append(line)
            else:
                parts.append(line)
        if open_at is not None:
            parts.append(keep("\n".join("    " + x for x in body)))
        t = "\n".join(parts)
    if "<" in t:
        sub(re.compile(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", re.S | re.I), lambda m: "\n" + keep("\n".join("    " + x for x in html.unescape(m.group(1)).strip("\n").split("\n"))) + "\n", 0)
        sub(COMMENT, "", 0)
        sub(DROPPED, "", 0)
    if "$" in t or "\\" in t:
        sub(DISPLAY, lambda m: keep("$$" + re.sub(r"\s+", " ", (m.group(1) or m.group(2)).strip()) + "$$"), 3)
        sub(PAREN_MATH, lambda m: keep("$" + m.group(1).strip() + "$"), 3)
        sub(DOLLAR_MATH, lambda m: keep("$" + m.group(1).strip() + "$"), 3)
    if "`" in t:
        sub(INLINE_CODE, lambda m: keep(m.group(2)), 1)
    if "<" in t:
        def tag(m: re.Match) -> str:
            name, close = m.group(2).lower(), m.group(1)
            if name in ("br", "p", "div", "tr", "ul", "ol", "table", "section", "article", "header", "footer", "blockquote", "dl", "hr", "title", "main", "aside", "nav", "form", "body", "head", "html", "pre"):
                return "\n"
            if name == "li" or name in ("dt", "dd"):
                return "" if close else "\n- "
            if name in ("td", "th"):
                return " | " if close else ""
            if len(name) == 2 and name[0] == "h" and name[1].isdigit():
                return "\n\n"
            return ""

        sub(TAG, tag, 0)
    if "&" in t:
        def entity(m: re.Match) -> str:
            got = html.unescape(m.group(0))
            if got == m.group(0):
                return got
            n[0] += 1
            return got.replace("\xa0", " ")

        t = ENTITY.sub(entity, t)
        if "<" in t:  # tags that stood as entities
            t = TAG.sub("", t)
    if "{" in t:
        sub(BRACE_MACRO, "", 2)
        sub(TEMPLATE, lambda m: ", ".join(x.strip() for x in m.group(1).split("|")[1:] if x.strip()) if "|" in m.group(1) else "", 2)
    if "[" in t:
        sub(WIKI_LINK, lambda m: "" if re.match(r"(?i)(?:category|kategorie|catégorie|categoría|file|datei|image|bild|fichier|archivo)\s*:", m.group(1)) else m.group(1).split("|")[-1], 2)
        sub(EXT_LINK, lambda m: m.group(1) or "", 2)
        sub(IMAGE, lambda m: m.group(1), 1)
        sub(LINK, lambda m: m.group(1), 1)
        sub(FOOTNOTE, "", 1)
        sub(REF_DEF, "", 1)
        sub(REF_LINK, lambda m: m.group(1), 1)
        sub(TASK, lambda m: m.group(1) + ("(done) " if m.group(2) != " " else ""), 1)
    if "\\" in t:
        sub(ENVIRON, "", 3)
        sub(TEX_HEAD, lambda m: "\n" + m.group(2) + "\n", 3)
        sub(TEX_NOTE, lambda m: f" ({m.group(2)})" if m.group(1) == "footnote" else "", 3)
        for _ in range(3):  # styles may be nested
            before = n[3]
            sub(TEX_STYLE, lambda m: m.group(2), 3)
            if n[3] == before:
                break
        sub(TEX_ITEM, "- ", 3)
        sub(TEX_BARE, "", 3)
        sub(TEX_ESCAPE, lambda m: m.group(1) or m.group(2), 3)
        sub(TEX_BREAK, "\n", 3)
    if "|" in t or "!" in t:
        if "{|" in t or "\n|-" in t or "\n|}" in t:
            before = n[2]
            sub(WIKI_TABLE, "", 2)
            if n[2] > before:
                t = WIKI_CELL.sub(lambda m: "| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", m.group(1)) + " |", t)
        if "||" in t:
            sub(DOUBLE_BAR, lambda m: " | ".join(x.strip() for x in m.group(1).split("||")), 2)
        if "|" in t and "--" in t:
            sub(TABLE_RULE, "", 1)
        if "\n|" in t or "\n |" in t or t.lstrip(" \t").startswith("|"):
            sub(TABLE_ROW, lambda m: " | ".join(x.strip() for x in m.group(1).split("|")), 1)
    if "\n=" in t or "\n =" in t or t.lstrip().startswith("="):
        sub(WIKI_HEAD, lambda m: "\n" + m.group(2) + "\n", 2)
    if not mail:
        if RULE_BELOW.search(t):
            sub(SETEXT, lambda m: m.group(1) + "\n", 1)
        if ">" in t:
            sub(BLOCKQUOTE, "", 1)
    if "#" in t:
        sub(ATX, lambda m: m.group(2) + "\n", 1)
    if ". " in t and ("\nh" in t or t.startswith("h")):
        sub(H_DOT, lambda m: m.group(2) + "\n", 2)
    if "''" in t:
        sub(WIKI_QUOTES, lambda m: m.group(1), 2)
    if "*" in t:
        sub(STRONG, lambda m: m.group(2), 1)
        sub(EMPH, lambda m: m.group(1), 1)
    if "~~" in t:
        sub(STRIKE, lambda m: m.group(1), 1)
    if "_" in t:
        sub(MAGIC, "", 2)
        sub(UNDER, lambda m: m.group(2), 1)
    if not any(n):
        return text, (0, 0, 0, 0)
    while "\x00" in t:
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], t)
    t = re.sub(r"[ \t]+\n", "\n", t)
    t = re.sub(r"\n{3,}", "\n\n", t).strip("\n")
    return t, (n[0], n[1], n[2], n[3])


SCHEMA = "id long, clean string, n_html int, n_markdown int, n_wiki int, n_latex int"
#: A path loses the vote of its host when this many pages agree that most of its text is links.
FRAME_LINKS, FRAME_PAGES = 0.5, 3
#: The path of a page itself: what stands in no container.  It always wins.
ROOT = ""


def page_paths(pages: DataFrame) -> DataFrame:
    """(id, path, own, links): the score of each container path of each page (id, text), each
    path of a page once; every page has its root."""

    def make():
        def f(ids, texts):
            i, p, own, links = [], [], [], []
            for page, text in zip(ids, texts):
                score: dict[str, list[int]] = {ROOT: [0, 0]}
                for path, _, _, a, b in containers(text or ""):
                    s = score.setdefault(path, [0, 0])
                    s[0] += a
                    s[1] += b
                for path, (a, b) in score.items():
                    i.append(page), p.append(path), own.append(a), links.append(b)
            return i, p, own, links

        return f

    return map_rows(pages, ["id", "text"], make, "id long, path string, own long, links long")


def vote(scored: DataFrame) -> DataFrame:
    """(host, path) of the container paths that win as content of their host.

    scored: (id, host, path, own, links).  The vote sums text and links per (host, path) with
    partial sums before the shuffle, and a path counts once per page.  A path loses when it
    stands on at least FRAME_PAGES pages of the host and links hold at least FRAME_LINKS of its
    text; less agreement leaves it with the content.
    """
    n = scored.groupBy("host", "path").agg(F.sum("own").alias("own"), F.sum("links").alias("links"), F.countDistinct("id").alias("n"))
    lost = (F.col("path") != ROOT) & (F.col("n") >= FRAME_PAGES) & (F.col("own") > 0) & (F.col("links") >= FRAME_LINKS * F.col("own"))
    return n.where(~lost).select("host", "path")


def clean_markup(docs: DataFrame, hosts: DataFrame | None = None, on: str = "file_id") -> DataFrame:
    """(id, clean, n_html, n_markdown, n_wiki, n_latex) for every row of docs (id, text, and `on`).

    hosts: (on, host), each `on` once; without it, or for rows it lacks, all pages are of one
    host.  Null texts stay null, texts without markup stay as they are with counts of 0.  Pages
    with HTML containers are scored, their host votes on the paths, and they are extracted again
    from the paths that won; all other texts have only the root, which always wins.  Repeated
    ids give repeated rows and vote as one page.  Only ids and paths meet the hosts; a text is
    moved once, by its own id, so a host with most of the pages is no hot key for texts.
    """
    docs = docs.select("id", "text", *([on] if hosts is not None else []))
    boxed = F.coalesce(F.col("text").rlike("(?i)<(" + "|".join(CONTAINERS.split()) + r")[\s>]"), F.lit(False))

    def make():
        def f(ids, texts, content=None):
            out = []
            for t, won in zip(texts, content or [None] * len(ids)):
                lost = {c[0] for c in containers(t)} - set(won) if won is not None else set()
                out.append(convert(t, lost))
            return ids, [g[0] for g in out], *[[g[1][i] for g in out] for i in range(4)]

        return f

    pages = docs.where(boxed)
    scored = cut(page_paths(pages))
    if hosts is None:
        placed = scored.withColumn("host", F.lit(""))
    else:
        of = pages.select("id", on).distinct().join(hosts.select(on, "host").dropDuplicates([on]), on, "left").groupBy("id").agg(F.min(F.coalesce("host", F.lit(""))).alias("host"))
        placed = cut(scored.join(of, "id"))
    won = placed.join(vote(placed), ["host", "path"], "left_semi").groupBy("id").agg(F.collect_set("path").alias("content"))
    paged = pages.select("id", "text").join(won, "id")
    return map_rows(docs.where(~boxed), ["id", "text"], make, SCHEMA).unionByName(map_rows(paged, ["id", "text", "content"], make, SCHEMA))
