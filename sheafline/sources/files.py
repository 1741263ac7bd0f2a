"""Files of a folder: the walk, decoding and extraction of text blocks by kind.

Extraction runs in Arrow batches over Spark's binary file source; a block is (text, loc,
heading).  PDF and pictures need an injected extractor, as do legacy office files.
"""

from __future__ import annotations

import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.sources.sheets import _xml, xlsx_rows

# Folders, endings and kinds of file.
IGNORED_DIRS = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", "$RECYCLE.BIN", "System Volume Information")
PARTIAL = (".tmp", ".crdownload", ".part")
TEXT_EXT = (".txt", ".log", ".csv", ".tsv", ".ini", ".cfg", ".yaml", ".yml", ".sql", ".py", ".tex", ".rst")
SUPPORTED = (*TEXT_EXT, ".md", ".html", ".htm", ".xml", ".json", ".jsonl", ".rtf", ".eml", ".epub", ".docx", ".pptx", ".xlsx", ".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".msg")
MAX_MB = 200
ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "cp1252", "latin-1")


def walk(spark: SparkSession, root: str, max_mb: int = MAX_MB) -> DataFrame:
    """(path, size, mtime, ext) of the supported files below a folder.

    Left out: ignored folders, names of unfinished or lock files, folders that begin with a
    tilde, other kinds, empty files and files over `max_mb`.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    bad_dir = F.col("path").rlike("/(" + "|".join(re.escape(d) for d in IGNORED_DIRS) + ")/|/~[^/]*/")
    bad_name = name.startswith("~$") | name.startswith(".~") | F.lower(name).rlike("(" + "|".join(re.escape(p) for p in PARTIAL) + ")$")
    return f.withColumn("ext", ext).where(~bad_dir & ~bad_name & F.col("ext").isin(*SUPPORTED) & (F.col("size") > 0) & (F.col("size") <= max_mb * 1024 * 1024))


def stage_summary(scan: DataFrame) -> DataFrame:
    return scan.groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def decode(b: bytes) -> str:
    """The text of bytes in the first encoding that fits."""
    if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return b.decode("utf-16", "replace").removeprefix("\ufeff")
    for e in ENCODINGS:
        if e == "utf-16":
            continue
        try:
            return b.decode(e).removeprefix("\ufeff")
        except UnicodeDecodeError:
            pass
    return b.decode("latin-1")


def clean(s: str) -> str:
    s = re.sub(r"[ \t\v\f\r]+", " ", s.replace("\0", " ").replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in s.split("\n"))).strip()


class _Html(HTMLParser):
    """Text of a page: scripts and the head out, block tags to line ends."""

    SKIP = {"script", "style", "noscript", "svg", "head", "template"}
    BLOCK = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "dt", "dd"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif tag in self.BLOCK:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def html_text(s: str) -> str:
    p = _Html()
    p.feed(s)
    p.close()
    return clean("".join(p.out))


Block = tuple[str, str, str]


def markdown_blocks(s: str) -> list[Block]:
    """A block per heading, which is carried."""
    out, head, buf = [], "", []

    def flush():
        t = clean("\n".join(buf))
        if t:
            out.append((t, f"section {len(out) + 1}", head))

    for line in s.split("\n"):
        m = re.match(r"#{1,6}\s+(.*\S)\s*$", line)
        if m:
            flush()
            head, buf = m.group(1), []
        else:
            buf.append(line)
    flush()
    return out


def rtf_text(s: str) -> str:
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    s = re.sub(r"\\(?:par|line|row)\b ?", "\n", s)
    return clean(re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", s)))


def mail_blocks(b: bytes) -> list[Block]:
    m = email.message_from_bytes(b, policy=email.policy.default)
    head = [f"{h}: {m[h]}" for h in ("From", "To", "Cc", "Date", "Subject") if m[h]]
    body = m.get_body(preferencelist=("plain", "html"))
    text = ""
    if body is not None:
        try:
            text = body.get_content()
        except (LookupError, UnicodeDecodeError):
            text = decode(body.get_payload(decode=True) or b"")
        if body.get_content_type() == "text/html":
            text = html_text(text)
    names = [a.get_filename() for a in m.iter_attachments() if a.get_filename()]
    if names:
        text += "\n\nAttachments: " + ", ".join(names)
    return [(clean("\n".join(head) + "\n\n" + text), "email", str(m["Subject"] or ""))]


def epub_blocks(b: bytes) -> list[Block]:
    out = []
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        for n in sorted(x for x in z.namelist() if re.search(r"\.x?html?$", x, re.I)):
            t = html_text(decode(z.read(n)))
            if len(t) > 40:
                out.append((t, f"chapter {len(out) + 1}", ""))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_blocks(b: bytes) -> list[Block]:
    """Paragraphs under their headings; a table is "cell | cell" lines."""
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        body = _xml(z.read("word/document.xml")).find(f"{_W}body")
    out, head, buf = [], "", []

    def flush():
        t = clean("\n".join(buf))
        if t:
            out.append((t, "", head))

    for e in body:
        if e.tag == f"{_W}p":
            t = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "" for x in e.iter())
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and re.match(r"(?i)heading|title", style.get(f"{_W}val") or ""):
                flush()
                head, buf = t.strip(), []
            else:
                buf.append(t)
        elif e.tag == f"{_W}tbl":
            for r in e.iter(f"{_W}tr"):
                cells = [" ".join("".join(x.text or "" for x in c.iter(f"{_W}t")).split()) for c in r.findall(f"{_W}tc")]
                buf.append(" | ".join(x for x in cells if x))
    flush()
    return out


def pptx_blocks(b: bytes) -> list[Block]:
    out = []
    with zipfile.ZipFile(io.BytesIO(b)) as z:
        names = z.namelist()
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        for k, n in enumerate(slides, 1):
            paras = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in _xml(z.read(n)).iter(f"{_A}p")]
            paras = [p for p in paras if p]
            note = f"ppt/notesSlides/notesSlide{k}.xml"
            if note in names:
                notes = ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in _xml(z.read(note)).iter(f"{_A}p")]
                paras += [f"Notes: {x}" for x in notes if x and not x.isdigit()]
            if paras:
                out.append((clean("\n".join(paras)), f"slide {k}", paras[0]))
    return out


def sheet_blocks(b: bytes, size: int = 40) -> list[Block]:
    out = []
    for name, rows in xlsx_rows(b).items():
        rows = [r for r in rows if any(c is not None and str(c).strip() for c in r)]
        if not rows:
            continue
        head = [str(c or "").strip() for c in rows[0]]
        for k in range(1, len(rows), size):
            lines = [" | ".join(f"{h or 'col'}: {str(v).strip()}" for h, v in zip(head, r) if v is not None and str(v).strip()) for r in rows[k : k + size]]
            out.append(("\n".join(lines), f"rows {k}-{min(k + size, len(rows)) - 1}", name))
    return out


def json_blocks(s: str, lines: bool) -> list[Block]:
    if lines:
        good = []
        for x in s.split("\n"):
            if x.strip():
                try:
                    good.append(json.dumps(json.loads(x), ensure_ascii=False))
                except ValueError:
                    good.append(x.strip())
        return [("\n".join(good), "", "")]
    try:
        return [(json.dumps(json.loads(s), indent=1, ensure_ascii=False), "", "")]
    except ValueError:
        return [(clean(s), "", "")]


def extract(ext: str, b: bytes, extra: dict[str, Callable[[bytes], list[Block]]] | None = None) -> list[Block]:
    """Blocks of one file.  `extra` adds or replaces extractors by ending."""
    ext = ext.lower()
    if extra and ext in extra:
        got = extra[ext](b)
    elif ext == ".md":
        got = markdown_blocks(decode(b))
    elif ext in (".html", ".htm"):
        got = [(html_text(decode(b)), "", "")]
    elif ext == ".xml":
        got = [(clean(re.sub(r"<[^>]+>", " ", decode(b))), "", "")]
    elif ext in (".json", ".jsonl"):
        got = json_blocks(decode(b), ext == ".jsonl")
    elif ext == ".rtf":
        got = [(rtf_text(decode(b)), "", "")]
    elif ext == ".eml":
        got = mail_blocks(b)
    elif ext == ".epub":
        got = epub_blocks(b)
    elif ext == ".docx":
        got = docx_blocks(b)
    elif ext == ".pptx":
        got = pptx_blocks(b)
    elif ext == ".xlsx":
        got = sheet_blocks(b)
    elif ext in TEXT_EXT:
        got = [(clean(decode(b)), "", "")]
    else:
        raise ValueError(f"no extractor for {ext}")
    return [(t, loc or "", h or "") for t, loc, h in got if t and t.strip()]


def extract_files(spark: SparkSession, paths: DataFrame, extra: dict | None = None) -> DataFrame:
    """(path, block, text, loc, heading, error) of the files at `paths` (path, ext).

    Files are read where they are extracted, one after the other; a file that fails gives one
    row with its error and no text.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import unquote, urlparse

        from pyarrow import fs

        for pdf in it:
            for path, ext in zip(pdf["path"], pdf["ext"]):
                rows = []
                try:
                    u = urlparse(path)
                    f, p = (fs.LocalFileSystem(), unquote(u.path)) if u.scheme in ("", "file") else fs.FileSystem.from_uri(path)
                    with f.open_input_stream(p) as s:
                        b = s.read()
                    rows = [(path, i, t, loc, h, None) for i, (t, loc, h) in enumerate(extract(ext, b, extra))]
                except Exception as e:
                    rows = [(path, 0, None, None, None, f"{type(e).__name__}: {e}"[:300])]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "block", "text", "loc", "heading", "error"])

    return paths.select("path", "ext").mapInPandas(run, "path string, block int, text string, loc string, heading string, error string")
