"""p2, p4, p6, p8, p10: texts with defects, texts that only look like it, and edge cases."""

import datetime
import random

import pytest

from sheafline.llm import leak, mail, markup, pii, scan

MARKUP = [
    ("<p>One</p><p>Two &amp; three</p>", "One\n\nTwo & three"), ("A **bold** and `x_1` word", "A bold and x_1 word"), ("## Head\n\ntext", "Head\n\ntext"), ("Head\n====\ntext", "Head\n\ntext"),
    ("[a link](x/y.html) and ![pic](p.png)", "a link and pic"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a | b\n\n1 | 2"), ("== Head ==\ntext [[Page|shown]]", "Head\n\ntext shown"), ("{{Box|name=x}} '''bold'''", "name=x bold"),
    ("\\section{Head}\nA \\emph{word}~\\cite{k2}, 10\\% of $x_{1} = \\alpha$", "Head\n\nA word, 10% of $x_{1} = \\alpha$"), ("h2. Head\ntext", "Head\n\ntext"), ("- [x] done\n- [ ] open", "- (done) done\n- open"), ("text[^4] on", "text on"),
    ("a\n```sql\nselect *_x_*\n```\nb", "a\n    select *_x_*\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("~~gone~~ stays", "gone stays"), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("{code}\nrun\n{code}", "run"),
]
PLAIN = ["- one\n- two", "1. one\n2. two", "2 * 3 * 5 and 4 < 5 > 3", "If a<b or b>c the relay opens", "was $45.00, down from $52.10.", "ticket #4471 and file_name_v2", "D:\\archive\\notes\\new is the path", "model: a | qty: b | price: 3", "R&D and F&E", "Keep < 40 l/min and\n> 12 l/min", "the noise was ~70 dB", "Tolerances [mm] are listed", "", "  "]
MAIL_PLAIN = "From: A B <a@b.example>\nTo: c@d.test\nSubject: x\n\nHi,\ntext\n---\nthe rule\n\n> quoted\n> text\n____\nA B"


@pytest.mark.parametrize("text,clean", MARKUP)
def test_markup_is_found_and_converted(text, clean):
    got, n = markup.convert(text)
    assert sum(n) > 0 and got.strip() == clean.strip()
    assert sum(markup.convert(got)[1]) == 0 or "$" in got or "    " in got  # formulas and code keep their form


@pytest.mark.parametrize("text", [*PLAIN, MAIL_PLAIN, None])
def test_plain_text_stays(text):
    assert markup.convert(text) == (text, (0, 0, 0, 0))


def test_the_sign_filter_misses_nothing(spark):
    rows = [(i, t) for i, (t, _) in enumerate(MARKUP)]
    from pyspark.sql import functions as F

    assert spark.createDataFrame(rows, "id long, text string").where(~F.col("text").rlike(markup.ANY_SIGN)).count() == 0


SIGNS = {
    "TAG": "<b>", "COMMENT": "<!-- x -->", "DROPPED": "<style>x</style>", "ENTITY": "&amp;", "FENCE": "~~~", "INLINE_CODE": "`x`", "IMAGE": "![a](b)", "LINK": "[a](b)", "REF_LINK": "[a][b]", "REF_DEF": "[a]: /b",
    "FOOTNOTE": "x[^1]", "ATX": "# x", "SETEXT": "x\n---", "TABLE_RULE": "Part | Qty\n--- | ---\nPump | 3", "TABLE_ROW": "| a |", "STRONG": "**x**", "EMPH": "*x*", "UNDER": "_x_", "STRIKE": "~~x~~", "TASK": "- [ ] x",
    "BLOCKQUOTE": "> x", "WIKI_LINK": "[[x]]", "EXT_LINK": "[http://x y]", "TEMPLATE": "{{x}}", "WIKI_HEAD": "= x =", "WIKI_QUOTES": "''x''", "DOUBLE_BAR": "||x||", "BRACE_MACRO": "{code}", "H_DOT": "h1. x", "MAGIC": "x__TOC__",
    "DISPLAY": "$$x$$", "PAREN_MATH": "\\(x\\)", "DOLLAR_MATH": "$x$", "ENVIRON": "\\begin{x}", "TEX_ITEM": "\\item x", "TEX_HEAD": "\\section{x}", "TEX_NOTE": "\\cite{x}", "TEX_STYLE": "\\emph{x}", "TEX_BARE": "\\par", "TEX_ESCAPE": "\\%", "TEX_BREAK": "x\\\\",
}


@pytest.mark.parametrize("name,text", [*SIGNS.items(), ("TABLE_RULE", "a | b\n:-- | --:\nc | d"), ("TABLE_RULE", "a | b\n  -- | --\nc | d")])
def test_each_pattern_passes_the_sign_filter(name, text):
    assert getattr(markup, name).search(text) and markup._ANY.search(text) and sum(markup.convert(text)[1]) > 0


def test_hosts_vote_on_frames(spark):
    page = '<div class="nav7"><a href="/a">one of the links</a> <a href="/b">another link</a></div><div class="body">Real text {} with <a href="x">one link</a> that stays.</div>'
    docs = spark.createDataFrame([(i, 1, page.format(i), "x", 9) for i in range(4)] + [(9, 2, page.format(9), "x", 9), (10, None, None, "x", 9), (11, 1, "", "x", 9)], "id long, file_id long, text string, host string, n_html int")
    hosts = spark.createDataFrame([(1, "h"), (2, "lonely")], "file_id long, host string")
    got = {r.id: r.clean for r in markup.clean_markup(docs, hosts).collect()}
    assert all("another link" not in got[i] and "one link that stays" in got[i] for i in range(4))
    assert "another link" in got[9]  # one page is no consensus
    assert got[10] is None and got[11] == "" and len(got) == 7
    assert markup.clean_markup(docs.where("id < 0"), hosts).count() == 0


def test_many_lists_of_one_page_are_no_frame(spark):
    page = "<p>Body.</p>" + "".join(f'<ul><li><a href="/{i}">reference {i}</a></ul>' for i in range(5))
    docs = spark.createDataFrame([(1, page), (1, page), (1, page), (2, page)], "id long, text string")
    assert all("reference 4" in r.clean for r in markup.clean_markup(docs).collect())
    third = docs.unionByName(spark.createDataFrame([(3, page)], docs.schema))
    assert all("reference" not in r.clean for r in markup.clean_markup(third).collect())


def test_pages_are_extracted_from_the_paths_that_win(spark, monkeypatch):
    page = '<nav class="top3"><a href="/a">menu</a></nav><div class="main">Body {}</div>'
    docs = spark.createDataFrame([(i, 1, page.format(i)) for i in range(4)] + [(9, 1, "plain text"), (9, 1, "plain text"), (10, 1, "**bold**")], "id long, file_id long, text string")
    hosts = spark.createDataFrame([(1, "h"), (1, "h")], "file_id long, host string")
    placed = markup.page_paths(docs.where("id < 9").select("id", "text")).selectExpr("*", "'h' as host")
    assert {r.path for r in markup.vote(placed).collect()} == {"", "div.main"}
    got = {r.id: (r.clean.strip(), r.n_html > 0) for r in markup.clean_markup(docs, hosts).collect()}
    assert got == {**{i: (f"Body {i}", True) for i in range(4)}, 9: ("plain text", False), 10: ("bold", False)}
    # Without a winner no page with containers comes out: their rows are those of the vote.
    vote = markup.vote
    monkeypatch.setattr(markup, "vote", lambda s: vote(s).where("false"))
    assert {r.id for r in markup.clean_markup(docs, hosts).collect()} == {9, 10}


def test_frames_within_frames_leave_the_body():
    body = "BODY TEXT OF THE PAGE THAT MUST STAY, all of it."
    nav = '<nav><ul><li><a href="/a">one link</a></ul><ul><li><a href="/b">two</a></ul></nav>'
    got, n = markup.convert(nav + body + nav, {"nav", "nav/ul"})
    assert got.strip() == body and n[0] == 6


def test_very_long_texts():
    t = "word <b>x</b> " * 40_000
    assert sum(markup.convert(t)[1]) == 80_000
    assert len(pii.Finder().find("plain words only " * 40_000)) == 0
    assert len(leak.words("Ä b_c " * 100_000)) == 300_000
    assert mail.newly_written("Hello there, this is text. " * 20_000)


MAILS = [
    ("Hi,\n\nLong authored text that goes on for a while and says something.\n\nRegards,\nAnna", set()),
    ("Text by me here.\n\nOn 19/2/2025 Bob Stone <b@x.example> wrote:\n> old text\n> more", {"quote"}),
    ("Text by me.\n\n-----Original Message-----\nFrom: Bob <b@x.example>\nSent: 1/1/2025\nSubject: x\n\nold text here", {"quote"}),
    ("Text by me.\n\nThanks\nAnna\n-- \nAnna Stone\nPurchasing\nPhone +49 555 881 936", {"signature"}),
    ("Text.\n\nCheers\nAnna\nSent from my handset", {"signature"}),
    ("Text.\n*****\nThe contents of this e-mail are confidential. Anyone else must not copy it.", {"disclaimer"}),
    ("[External sender - take care with links]\n\nText by me that is long enough to count as text.", {"disclaimer"}),
    ("Please keep this draft confidential until Friday. From: and To: fields on the label are swapped.", set()),
    ("As Larelsha wrote on Monday, the seals are late. The note was sent from my desk.", set()),
    ("Keep the flow below that and the return\n> 12 l/min at all times.", set()),
    ("", set()), (None, set()),
]


@pytest.mark.parametrize("body,want", MAILS)
def test_mail_pieces(body, want):
    text = None if body is None else "From: Anna Stone <anna.stone@x.example>\nTo: b@y.test\nDate: 2025-01-01\nSubject: s\n\n" + body if body else body
    got = {mail.LABELS[k] for k, _ in mail.decode(text)} - {"authored"}
    assert got == {{"quote": "quoted"}.get(w, w) for w in want}


def test_only_new_text_is_left():
    t = "From: A B <a.b@x.example>\nSubject: s\n\nMy new text.\n\nOn 1/1/2025, C D wrote:\n> old\n\nMore of mine, below the quote."
    got = mail.newly_written(t)
    assert "My new text." in got and "More of mine" in got and "old" not in got and mail.newly_written(None) is None


def test_mail_frame(spark):
    d = spark.createDataFrame([(1, None, True), (2, "", True), (2, "", True), (3, "Text\n\nSent from my phone", True)], "id long, text string, quote boolean")
    got = sorted((r.id, r.authored, r.signature) for r in mail.reduce_mails(d).collect() if r.authored is not None)
    assert got == [(2, "", False), (2, "", False), (3, "Text", True)]
    assert mail.reduce_mails(d.limit(0)).count() == 0


def span_score(k, i, j, emit, start, phone, called, legal, marked):
    s = sum(e[k] for e in emit[i:j]) + start[i][k] + mail.SWITCH
    if k == mail.SIGNATURE:
        s += (1.5 if any(phone[i:j]) and any(called[i:j]) else 0) - 0.8 * (j - i - 1)
    if k == mail.QUOTED and (start[i][k] > 0 or emit[i][k] > 3):
        s += 1.6 * (j - i - 1) + (2.5 if j - i > 1 and start[i][k] > 0 and not marked[i + 1] else 0)
    return s + (1.0 if k == mail.DISCLAIMER and sum(legal[i:j]) >= 2 else 0)


def test_the_linear_decoder_finds_the_best_spans():
    """Against all spans of all lengths."""
    r = random.Random(6)
    for _ in range(120):
        n = r.randint(1, 14)
        f = ([[r.uniform(-4, 6) for _ in range(4)] for _ in range(n)], [[r.choice((0, 0, 3.5)) for _ in range(4)] for _ in range(n)], [r.random() < 0.3 for _ in range(n)], [r.random() < 0.3 for _ in range(n)], [r.choice((0, 0, 1, 2)) for _ in range(n)], [r.random() < 0.5 for _ in range(n)])
        best = [[0.0] * 4] + [[-1e9] * 4 for _ in range(n)]
        for j in range(1, n + 1):
            for i in range(j):
                for k in range(4):
                    before = 0.0 if not i else max(best[i][p] for p in range(4) if p != k or k == mail.QUOTED)
                    best[j][k] = max(best[j][k], before + span_score(k, i, j, *f))
        spans = mail._spans(*f)
        assert [a for _, a, _ in spans] == [0, *[e for _, _, e in spans[:-1]]] and spans[-1][2] == n
        assert sum(span_score(k, i, j, *f) for k, i, j in spans) == pytest.approx(max(best[n]))


def test_contact_blocks_with_blank_lines():
    top = "From: Anna Stone <anna.stone@x.example>\nTo: b@y.test\nSubject: s\n\n"
    body = "The text that I wrote is long enough to count as text.\n\nBest regards\n\n"
    card = "Anna Stone\n\nHead of Purchasing\n\nStone Works Ltd\n\nPhone +49 555 881 936\n\n12 Mill Road\n\n9000 Harbour"
    assert mail.newly_written(top + body + card) == body.strip()
    # Short lines without a contact are text.
    assert mail.newly_written(top + body + "Anna Stone\n\nseals\n\npumps") == (body + "Anna Stone\n\nseals\n\npumps").strip()


def test_long_mails_take_linear_time():
    import time

    def took(n):
        t = "From: A B <a@b.example>\n\n" + "\n\n".join(f"Text of block {i} that goes on." for i in range(n))
        a = time.perf_counter()
        mail.decode(t)
        return time.perf_counter() - a

    took(100)
    assert took(4000) < 30 * took(400)


# --- scanned pages ---------------------------------------------------------------------
CLEAN = ["The intake valve recorded the agreed tolerance before the summer break and the inlet- and outlet-side checks were done. The arm of the form is warm."] * 60


def pages(spark, rows):
    return spark.createDataFrame(rows, "id long, file_id long, text string, line int, key string")


def found(spark, rows):
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    return sorted({(r.id, r.defect) for r in scan.findings(pages(spark, [(*r, 1, "x") for r in rows]), clean).collect()})


def test_defects_of_pages(spark):
    rows = [
        (1, 1, "Acme   The report   Rev. 5\n\nThe intake valve recorded the agreed tole-\nrance before the summer break.\n\n— 12 —"),
        (2, 1, "Acrne   The report   Rev. 5\n\nThe intake valve recorded the agreed tolerance\nbefore the summer break, see page 31."),
        (3, 2, "A title of its own\n\nThe intake va1ve recorded the agreed tolerance."),
        (4, 2, "The inlet- and outlet-\nside checks were done in- and out of the sum mer break."),
        (5, 2, "The intake valve recorded the agreed\n[13]\ntolerance, teh valve of code B10-O2."),
        (6, 3, None), (7, 3, ""), (10, 4, "The agreed tol\nerance and the valve.\n\n2l"), (8, None, "The valve."),
    ]
    want = {(1, "header"), (1, "hyphen"), (1, "page"), (2, "header"), (3, "chars"), (4, "chars"), (5, "page"), (10, "chars"), (10, "page")}
    assert set(found(spark, rows)) == want


def test_frequent_words_do_not_decide(spark):
    clean = spark.createDataFrame([(t,) for t in [*CLEAN, *CLEAN, *["Some sum and mer. "] * 500, "It is warrn.", "So warrn it is."]], "text string")
    rows = [(1, 1, "The cup was warrn today."), (2, 2, "They met before the sum mer break."), *[(10 + i, 10 + i, f"The summer of the form {i} was warm.") for i in range(6)]]
    for frequent in (0, 5, 50_000):
        got = {(r.id, r.a, r.b, r.fix) for r in scan.findings(pages(spark, [(*r, 1, "x") for r in rows]), clean, frequent).collect() if r.defect == "chars"}
        assert got == {(1, "warrn", None, "warm"), (2, "sum", "mer", "summer")}


def test_repair(spark):
    p = pages(spark, [(1, 1, "Acme   The report   Rev. 5\n\nThe intake va1ve recorded the agreed tole-\nrance before the sum mer break.\n\n— 12 —", 1, "x"), (2, 1, "Acme   The report   Rev. 5\n\nMore.", 1, "x"), (3, 1, None, 1, "x")])
    got = {r.id: r.repaired for r in scan.repair(p, spark.createDataFrame([(t,) for t in CLEAN], "text string")).collect()}
    assert got == {1: "The intake valve recorded the agreed tolerance before the summer break.", 2: "More.", 3: None}


def test_no_pages_and_no_vocabulary(spark):
    none = spark.createDataFrame([], "text string")
    assert scan.findings(pages(spark, []), none).count() == 0
    got = scan.findings(pages(spark, [(1, 1, "xv\nThe va1ve", 1, "x")]), none).collect()
    assert [r.defect for r in got] == ["page"]


@pytest.mark.parametrize("line,page,rest", [("— 12 —", True, ""), ("Page 3 / 9", True, ""), ("xiv", True, ""), ("[3O]", True, ""), ("17", True, ""), ("see page 31", False, "see page 31"), ("Acme    [33]", True, "Acme"), ("[40]   Acme", True, "Acme"), ("mix", False, "mix"), ("12 seals", False, "12 seals")])
def test_page_numbers(line, page, rest):
    assert scan.page_parts(line) == (page, rest)


def ordered(spark, rows, page=None):
    return spark.createDataFrame([(*r, page) for r in rows], "id long, file_id long, ord long, text string, page long")


def repaired(spark, rows, page=None, clean=CLEAN):
    return {r.id: r.repaired for r in scan.repair(ordered(spark, rows, page), spark.createDataFrame([(t,) for t in clean], "text string")).collect()}


def test_numbers_of_the_body_stay(spark):
    body = "Pumps delivered in week 12:\n42\nwere counted. Size is\nXL\nand area\n1999"
    flat = body.replace("\n", " ")
    assert repaired(spark, [(1, 1, None, body)]) == {1: flat}
    # Neither do numbers without a sequence go where the file's own page numbers are known.
    run = [(i, 1, i, f"{body}\n\n{30 + 2 * i}") for i in range(4)]
    assert repaired(spark, run) == {i: flat for i in range(4)}


def test_page_numbers_continue_over_the_file(spark):
    rows = [(i, 1, i, f"The intake valve recorded the\n{7 + i}\nagreed tolerance {i * i}.\n\n{90 - 31 * i % 17}") for i in range(40)]
    got = scan.findings(ordered(spark, rows), spark.createDataFrame([], "text string")).where("defect = 'page'").select("id").distinct().count()
    assert got == 40
    out = repaired(spark, rows)
    assert all(out[i].startswith(f"The intake valve recorded the agreed tolerance {i * i}.") for i in range(40))
    assert repaired(spark, [(1, 1, 0, "The intake valve recorded\n12\nthe agreed tolerance.")], 11) == {1: "The intake valve recorded the agreed tolerance."}


def test_written_hyphens_stay(spark):
    clean = [*CLEAN, *["A well-known state-of-the-art design."] * 3]
    rows = [(1, 1, 0, "It is a state-of-the-\nart valve, well-\nknown for its tole-\nrance, in- and\nInlet-\nOutlet."), (2, 1, 1, "Range 5-\n7 of it -\nand more.")]
    got = repaired(spark, rows, clean=clean)
    assert got == {1: "It is a state-of-the-art valve, well-known for its tolerance, in- and Inlet-Outlet.", 2: "Range 5-7 of it - and more."}
    found_ = scan.findings(ordered(spark, rows), spark.createDataFrame([(t,) for t in clean], "text string")).where("defect = 'hyphen'").count()
    assert found_ == 1


def test_repair_loses_no_sign_of_the_body(spark):
    import re

    r = random.Random(4)
    words = "valve 42 XL tolerance ix 3/4 [13] agreed-upon état 1999 in- and Page p. 7".split()
    rows = [(i, i % 3, i, "\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(12))) for i in range(60)]
    plain = ordered(spark, rows)
    gone = {x.id: (set(x.head_lines), set(x.page_lines)) for x in scan.marks(plain).collect()}
    out = repaired(spark, rows, clean=[])
    squeeze = lambda s: re.sub(r"[\s-]", "", s)
    for i, _, _, t in rows:
        h, p = gone.get(i, (set(), set()))
        left = "".join(scan.page_token(x)[1] if k in p else x for k, x in enumerate(t.split("\n")) if k not in h)
        assert squeeze(out[i]) == squeeze(left)


@pytest.mark.parametrize("token,want", [("— 12 —", ("dash", 12)), ("Page 3 / 9", ("word", 3)), ("p. 4O", ("word", 40)), ("xiv", ("roman", 14)), ("[3O]", ("bracket", 30)), ("2l", ("plain", 21)), ("3/4", ("ratio", 3)), ("Se!te 2", ("word", 2)), ("S. 4", ("word", 4))])
def test_values_of_page_numbers(token, want):
    assert scan.page_value(token) == want


def test_long_tokens_are_corrected():
    w = "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft".lower()
    assert w in scan.corrections(w.replace("d", "cl", 1).replace("m", "rn", 1))
    assert scan.corrections("m" * 100_000) == set()


# --- leaks -----------------------------------------------------------------------------
def brute_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice((11, 12, 20, 30))))) for i in range(25)] + [(98, ""), (99, None)]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(40)]
        if d % 2:
            src = r.choice(items[:25])[1].split()
            n = r.choice((10, 11, 12, 13))
            w[5:5] = src[:n]
        docs.append((d, ("É" if d % 3 else "") + " ".join(w).upper() if d % 5 == 0 else " _ ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (1, docs[1][1], "x")]
    D, I = spark.createDataFrame(docs, "id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, _ in docs for i, u in items if brute_run(leak.words(t), leak.words(u)) >= 12}
    for at_once in (20_000, 7):
        assert {(x.doc_id, x.item_id) for x in leak.leaked(leak.find_leaks(D, I, at_once=at_once)).collect()} == want
    assert len(want) > 10
    assert leak.find_leaks(D.limit(0), I).count() == 0 and leak.find_leaks(D, I.limit(0)).count() == 0


def test_hamming_blocks_miss_none():
    import numpy as np

    rng = np.random.default_rng(0)
    ix = leak.Index([(1, " ".join(f"a{i}" for i in range(30)))])
    size, fp, owner, blocks = ix.tables[0]
    for _ in range(200):
        f = fp[rng.integers(len(fp))]
        for b in rng.choice(64, 3, replace=False):
            f ^= np.uint64(1) << np.uint64(b)
        hit = any(np.any(keys == (f >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) for a, b, keys, _ in blocks)
        assert hit


def test_items_with_one_changed_word_are_found(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(48, 90)))) for i in range(60)]
    docs = []
    for i, t in items:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join([r.choice(vocab) for _ in range(30)] + w + [r.choice(vocab) for _ in range(30)])))
    D, I = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    # Passages alone are not enough where every twelfth word is changed.
    torn = [(100 + i, " ".join(x if k % 11 else "changed" for k, x in enumerate(t.split()))) for i, t in items]
    found_ = leak.find_leaks(D.unionByName(spark.createDataFrame(torn, D.schema)), I).collect()
    assert {(x.doc_id, x.item_id) for x in found_} == {(i, i) for i, _ in items}
    assert all(x.similarity >= 0.8 and x.share > 0.8 for x in found_)
    # The radius of item-sized windows: nearly all such windows are within it.
    ix, h = leak.Index(items), leak._Hashes()
    near = 0
    for (i, t), (_, d) in zip(items, docs):
        import numpy as np

        row = np.array(h.row(d), np.uint64)
        doc, item, size, *_ = ix.candidates(row, np.array([len(row)]))
        near += any(s > 12 and j == i for j, s in zip(item.tolist(), size.tolist()))
    assert near >= 55


def test_the_weighted_check_decides(spark):
    D, I = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)))], "id long, text string"), spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(40)))], "item_id long, text string")
    assert leak.find_leaks(D, I).count() == 1 and leak.find_leaks(D, I, threshold=1.01).count() == 0


# --- personal information --------------------------------------------------------------
FINDER = pii.Finder(["Hugo", "Carmen", "May", "Rose", "Will", "Petra"], ["Stone", "Field", "Iltiquell", "Winter"])
FOUND = [
    ("Write to Carmen21 [at] post.tallow.example for it.", {("email", "carmen21@post.tallow.example")}), ("mail=<a.b@c.test>;", {("email", "a.b@c.test")}), ("Contact: ilse dot x at nordpump dot invalid", {("email", "ilse.x@nordpump.invalid")}),
    ("Call +44 20 7946 0963 before noon", {("phone", "442079460963")}), ("The night line is +1-555-555-0151 (ext. 14).", {("phone", "15555550151")}), ("Tel.: 555-229-315", {("phone", "555229315")}), ("Mobil: 0049 (0)30 23125710 Das", {("phone", "004903023125710")}),
    ("National ID: QQ 05 79 29 C", {("idno", "QQ057929C")}), ("NIE Y-0026166-D El", {("idno", "Y0026166D")}), ("Die Steuer-ID lautet 07588367287", {("idno", "07588367287")}), ("Personalausweis L0A41PW48 lag vor", {("idno", "L0A41PW48")}), ("Passport 971-20-4810 was shown", {("idno", "971204810")}),
    ("lives at 99A Mill Road.", {("address", "99A Mill Road")}), ("Send to Flat 3, 131 Oak Street.", {("address", "131 Oak Street")}), ("Anschrift: Dosemstraße 99b, Ulm", {("address", "Dosemstraße 99b")}), ("Livrer au 133 bis, avenue Sulehe, 08960 X", {("address", "133 bis, avenue Sulehe")}), ("Entregar en Paseo del Velisste, n.º 33, 06874 C", {("address", "Paseo del Velisste, n.º 33")}),
    ("We spoke with Hugo Stone about it.", {("name", "Hugo Stone")}), ("cc STONE, Carmen The order", {("name", "STONE, Carmen")}), ("raised by Mr Winter last week", {("name", "Winter")}), ("Approved by: Ilse Sulor-Baker The pump", {("name", "Ilse Sulor-Baker")}), ("Thanks to Petra L. for it", {("name", "Petra L.")}), ("B. Wixa signed the protocol.", {("name", "B. Wixa")}),
]
#: Wordings and values that the test tables do not hold.
OTHER_WORDS = [
    ("Dial +31 20 555 0199 for the desk.", {("phone", "31205550199")}), ("The courier answers 0171 2345 6789 at weekends", {("phone", "017123456789")}), ("His driving licence X1234567 expired", {("idno", "X1234567")}), ("Führerschein B0726AB12 liegt vor", {("idno", "B0726AB12")}),
    ("Deliver to 4 Elm Terrace today", {("address", "4 Elm Terrace")}), ("Valve 12 Mill Road is a product name", set()), ("wohnhaft Lindenallee 7, Kiel", {("address", "Lindenallee 7")}), ("mail jo.doe+x@sub.dept.example now", {("email", "jo.doe+x@sub.dept.example")}), ("Signed: Petra Iltiquell, manager", {("name", "Petra Iltiquell")}), ("Stone Partners sent it", set()), ("Model Hugo Stone series", set()),
]
NOTHING = ["Serial no. 480-98-0126", "Order 0047-425-846 covers the Stone gasket.", "The Stone GmbH invoice over 67,312.00 is booked under 47218054.", "Our field crew", "Rose tint on the May batch", "Will stone chips damage it?", "Winter service starts at hall 30, gate 4.", "Part number 555-546-418", "runs since 2024-05-16", "The Field Road branch closes early.", "Stone & Co sent a list", "", None]


@pytest.mark.parametrize("text,want", FOUND)
def test_personal_information(text, want):
    assert {(k, v) for _, _, k, v in FINDER.find(text)} == want
    assert {(k, v) for _, _, k, v in FINDER.find(text.replace(" ", "\n", 1).replace(" ", "  ", 1))} >= {(k, v) for k, v in want if k in ("phone", "idno")}


@pytest.mark.parametrize("text,want", OTHER_WORDS)
def test_personal_information_in_other_words(text, want):
    assert {(k, v) for _, _, k, v in FINDER.find(text)} == want


@pytest.mark.parametrize("text", NOTHING)
def test_no_personal_information(text):
    assert FINDER.find(text) == []


@pytest.mark.parametrize("value", ["+44 20 7946 0963", "QQ057929C", "a", "7", "", "l0-x", "00.261.033-A"])
def test_pseudonyms_keep_the_form_and_come_back(value):
    key = b"k"
    p = pii.feistel(value, key, "phone")
    assert [(c.isdigit(), c.isalpha(), c.isupper()) for c in p] == [(c.isdigit(), c.isalpha(), c.isupper()) for c in value]
    assert pii.feistel(p, key, "phone", back=True) == value and pii.feistel(value, key, "phone") == p


def test_pseudonyms_are_a_permutation():
    assert len({pii.feistel(f"{i:03d}", b"k") for i in range(1000)}) == 1000
    day = datetime.date(1984, 2, 29)
    assert pii.permute_date(day, b"k") == pii.permute_date(day, b"k") != day
    with pytest.raises(ValueError):
        pii.permute_date(datetime.date(2400, 1, 1), b"k")


@pytest.mark.parametrize("value", ["12345678Z", "12345678A", "X1234567L", "X1234567A", "255081416802538", "255081416802500", "86095742719", "86095742718", "QQ057929C"])
def test_check_signs_stay_right_or_wrong(value):
    right = pii.has_right_check(value)
    assert right == (value in ("12345678Z", "X1234567L", "255081416802538", "86095742719"))
    for key in (b"k", b"other"):
        p = pii.pseudonym(value, key, "idno")
        assert p != value and pii.has_right_check(p) == right and pii.pseudonym(p, key, "idno", back=True) == value
        assert [c.isdigit() for c in p] == [c.isdigit() for c in value]


def test_a_right_check_sign_makes_an_identity_number():
    assert {k for _, _, k, _ in FINDER.find("phone or text 12345678Z here")} == {"idno"}
    assert FINDER.find("phone or text 12345678A here") == []


def test_found_values_come_from_the_placeholders(spark, monkeypatch):
    names = spark.createDataFrame([("Winter", "family")], "name string, kind string")
    d = spark.createDataFrame([(1, "Call +44 20 7946 0963, ID 12345678Z."), (2, None), (3, "")], "id long, text string")
    want = {(1, "phone", "442079460963"), (1, "idno", "12345678Z")}
    assert {tuple(r) for r in pii.find_pii(d, names).collect()} == want
    monkeypatch.setattr(pii, "placeholder", lambda k, v, shown, key: f"[{k.upper()} {shown}]")
    assert pii.revealed("phone", "442079460963", "+44 20 7946 0963", b"k") != "442079460963"


def test_dates(spark):
    t = "Born 1984-02-29 or 29.2.1984, 3/12/2001; not 1984-02-30, 1.2.3.2004 or version 2.10.2024.1"
    got = pii.dates(t)
    assert [(t[a:b], d.isoformat()) for a, b, d in got] == [("1984-02-29", "1984-02-29"), ("29.2.1984", "1984-02-29"), ("3/12/2001", "2001-12-03")]
    p = pii.permute_date(got[0][2], b"k")
    assert pii.permute_date(p, b"k", back=True) == got[0][2]
    d = spark.createDataFrame([(1, t)], "id long, text string")
    r = pii.redact(d, b"k", with_dates=True).first()
    assert r.n_found == 3 and f"[DATE {p.isoformat()}] or [DATE {p.day:02d}.{p.month:02d}.{p.year}]" in r.redacted and "1984-02-30" in r.redacted
    assert pii.redact(d, b"k").first().redacted == t


def test_long_sentences_and_far_cues():
    far = "The passport " + "that was renewed twice " * 4 + "is L0A41PW48 now."
    assert {v for _, _, k, v in FINDER.find(far)} == {"L0A41PW48"}
    assert {(k, v) for _, _, k, v in FINDER.find("lives at 12345 Mill Road.")} == {("address", "12345 Mill Road")}


def test_redaction_keeps_the_rest(spark):
    t = "Call +44 20 7946 0963, ask Mr Winter.\nUnit 5 is fine."
    d = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, "Call +44 20 7946 0963 now", 0)], "id long, text string, n_found int")
    names = spark.createDataFrame([("Winter", "family"), (None, "given")], "name string, kind string")
    got = {r.id: (r.redacted, r.n_found) for r in pii.redact(d, b"k", names).collect()}
    assert got[2] == (None, 0) and got[1][1] == 2
    ph = got[1][0].split("[PHONE ")[1].split("]")[0]
    assert got[1][0].startswith("Call [PHONE +") and got[1][0].endswith("].\nUnit 5 is fine.") and ph in got[3][0]
    assert pii.feistel("".join(filter(str.isdigit, ph)), b"k", "phone", back=True) == "442079460963"
    assert pii.find_pii(d.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        pii.find_pii(d, names, max_names=0)
