"""Scalar functions over columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that decorate a company's name without identifying it.
COMPANY_WORDS = ("pvt", "private", "ltd", "limited", "llp", "inc", "co", "company", "and", "the", "of", "services", "service")


def clean_text(c: Column) -> Column:
    """NUL and no-break space to blanks, runs of blanks to one, lines stripped, at most one empty
    line in a row, and the whole stripped.  Null stays null."""
    c = F.regexp_replace(c, "[\\x00\\xa0]", " ")
    c = F.regexp_replace(c, "[ \\t\\x0b\\f\\r]+", " ")
    c = F.regexp_replace(c, "(?m)^ | $", "")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def strip_xml(c: Column) -> Column:
    """Tags to blanks, then cleaned."""
    return clean_text(F.regexp_replace(c, "<[^>]+>", " "))


def row_text(df_columns: list[tuple[str, Column]]) -> Column:
    """"h: v | h: v" of the filled cells of a row; blank cells are skipped."""
    cells = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{h}: "), F.trim(c.cast("string")))) for h, c in df_columns]
    return F.concat_ws(" | ", *cells)


def words(c: Column) -> Column:
    """Runs of letters or digits in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def word_count(c: Column) -> Column:
    """How many `words` a text has."""
    return F.regexp_count(c, F.lit("[\\p{L}\\p{N}]+"))


def query_terms(c: Column, most: int = 32) -> Column:
    """Search terms: signs to blanks, words of two letters and more, the first `most`, repeats kept."""
    return F.slice(F.filter(F.split(F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}_\\s]", " ")), "\\s+"), lambda w: F.length(w) > 1), 1, most)


def label_key(c: Column) -> Column:
    """Identity of a label: its meaningful words, sorted, without case, signs and company words."""
    w = F.split(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(w, lambda x: (x != "") & ~x.isin(*COMPANY_WORDS)))), " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


# Marks of turns in chat templates.
CONTROL_TOKENS = "(?im)<\\|[^|>\\n]{0,48}\\|>|<</?SYS>>|\\[/?INST\\]|</?s>|^\\s*###\\s*(?:system|instruction|assistant|user)\\s*:"


def harden(c: Column) -> Column:
    """Chat control tokens to blanks."""
    return F.regexp_replace(c, CONTROL_TOKENS, " ")


# Small talk and words that point back to an earlier turn.
SMALL_TALK = (
    "(?i)^\\s*(hi+|hey+|hello+|yo|sup|namaste|hola|salaam|thanks?|thank you|thx|ty|ok(ay)?|k|cool|nice|great|awesome|perfect|good|good (morning|afternoon|evening|night)|"
    "bye|goodbye|see you|see ya|how are you|who are you|what can you do|what do you do|help|test|testing)(\\s+(there|all|again|mate|buddy|team|guys|everyone|bro|sir|man))?\\b[\\s!.?,]*$"
)
POINTS_BACK = "(?i)\\b(it|its|this|that|these|those|they|them|their|there|the same|above|instead|as well|too|also|which one|what about|how about)\\b"


def is_small_talk(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(SMALL_TALK), F.lit(False))


def points_back(c: Column) -> Column:
    """Holds a word that points to something said before."""
    return c.rlike(POINTS_BACK)


def is_follow_up(c: Column) -> Column:
    """Leans on the turn before: points back, or has four words or fewer."""
    q = F.regexp_replace(F.coalesce(c, F.lit("")), "^\\s+|\\s+$", "")
    return (q != "") & ~is_small_talk(q) & (q.rlike(POINTS_BACK) | (F.size(F.split(q, "\\s+")) <= 4))


def number_text(c: Column) -> Column:
    """The number of a text with optional thousands commas, sign and decimals; else null."""
    form = "^[-+]?\\d{1,3}(,\\d{3})*(\\.\\d+)?$|^[-+]?\\d*\\.?\\d+$"
    return F.when(F.trim(c).rlike(form), F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double"))


# Accepted forms of a date, tried in this order.
# One letter stands for one or two digits.
DATE_FORMS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "d/M/yyyy H:m:s", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d-MMM-yyyy", "yyyy/M/d")


def date_text(c: Column) -> Column:
    """The timestamp of a text of 8 to 26 signs in an accepted form; else null."""
    t = F.trim(c)
    return F.when(F.length(t).between(8, 26), F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMS]))


def months_between_dates(a: Column, b: Column) -> Column:
    """Whole months by calendar month, whatever the day."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def human_bytes(c: Column) -> Column:
    """A size in B, KB, MB or GB, with one decimal from KB on."""
    n = c.cast("double")
    steps = [(2**10, "B", 0), (2**20, "KB", 1), (2**30, "MB", 1)]
    out = F.when(F.lit(False), "")
    for top, unit, places in steps:
        out = out.when(F.abs(n) < top, F.concat(F.format_number(n / (top / 1024), places), F.lit(f" {unit}")))
    return F.when(n.isNotNull(), out.otherwise(F.concat(F.format_number(n / 2**30, 1), F.lit(" GB"))))


def human_time(c: Column) -> Column:
    """A duration in seconds as s, m and s, or h and m; null is still being estimated."""
    s = F.greatest(F.lit(0.0), c.cast("double"))
    n = F.bround(s).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.concat(F.floor(n / 3600).cast("string"), F.lit("h "), two(F.floor(n % 3600 / 60)), F.lit("m"))
    minutes = F.concat(F.floor(n / 60).cast("string"), F.lit("m "), two(n % 60), F.lit("s"))
    return F.when(c.isNull(), "estimating").when(s < 1, "less than a second").when(s < 60, F.concat(n.cast("string"), F.lit("s"))).when(s < 3600, minutes).otherwise(hours)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))
