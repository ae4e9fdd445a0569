"""Text from HTML, Markdown and plain files, and guesses of charset and media type; null on failure, never an error."""

from __future__ import annotations

import re
import zlib
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that stand on lines of their own, and those whose content is not text.
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th tr ul".split())
SKIPPED = {"script", "style", "noscript"}
MAGIC = ((b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"(\xb5/\xfd", "application/zstd"), (b"RIFF", "application/octet-stream"))
BY_NAME = {"html": "text/html", "htm": "text/html", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "json": "application/json", "csv": "text/csv", "tex": "application/x-tex", "xml": "application/xml", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipping = 0
        self.in_head = False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
        elif tag == "head" or tag == "title":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        self.parts.append("\n" if tag in BLOCK else " ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif tag in ("head", "title"):
            self.in_head = False
        self.parts.append("\n" if tag in BLOCK else " ")

    def handle_data(self, data):
        if not self.skipping and not self.in_head:
            self.parts.append(data)


def html_to_text(source: str) -> str:
    """Text of an HTML body: blocks on lines of their own, scripts, styles and the head left out."""
    parser = _Text()
    parser.feed(source)
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t\n]*", "\n", "".join(parser.parts).replace("\r", "\n"))
    return re.sub(r"[ \t]+", " ", text).strip()


def markdown_to_text(source: str) -> str:
    """Text of Markdown: code blocks left out, inline code and link texts kept, images by their description."""
    source = source.replace("\r\n", "\n")
    source = re.sub(r"(?ms)^ {0,3}(```+|~~~+)[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)", "", source)
    source = re.sub(r"(?m)(?:(?<=\n\n)|\A)(?: {4}|\t)[^\n]*(?:\n(?: {4}|\t)[^\n]*)*", "", source)
    source = re.sub(r"(?m)^ {0,3}\[[^\]\n]+\]:.*$", "", source)
    lines = []
    for line in source.split("\n"):
        if re.fullmatch(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*", line) or re.fullmatch(r" {0,3}(?:=+|-{2,}|(?:\* ?){3,}|(?:_ ?){3,})\s*", line):
            continue
        line = re.sub(r"^ {0,3}#{1,6}\s+(.*?)\s*#*$", r"\1", line)
        line = re.sub(r"^\s*(?:>\s?)+", "", line)
        line = re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?", "", line)
        if line.strip().startswith("|"):
            line = " ".join(c.strip() for c in line.strip().strip("|").split("|"))
        line = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", line)
        line = re.sub(r"\[([^\]]*)\](?:\([^)]*\)|\[[^\]]*\])", r"\1", line)
        line = re.sub(r"(`+)(.+?)\1", r"\2", line)
        line = re.sub(r"(\*\*\*|\*\*|\*|~~|(?<!\w)__?(?=\w))(\S(?:.*?\S)?)\1", r"\2", line)
        lines.append(unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", line)))
    return re.sub(r"\n{2,}", "\n", "\n".join(x.strip() for x in lines)).strip()


def charset_of(data: bytes) -> tuple[str, int]:
    """(charset, length of its byte order mark) of text: by its mark, by zero bytes at every other place, as UTF-8 if it is that
    throughout, as Windows-1251 if most of its letters lie beyond ASCII, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name, len(mark)
    if len(data) >= 4:
        even, odd = data[::2].count(0) / len(data[::2]), data[1::2].count(0) / len(data[1::2])
        if max(even, odd) > 0.4 and min(even, odd) < 0.1:
            return ("utf-16-le" if odd > even else "utf-16-be"), 0
    try:
        data.decode("utf-8")
        return "utf-8", 0
    except UnicodeDecodeError:
        pass
    plain, high = len(re.findall(rb"[A-Za-z]", data)), len(re.findall(rb"[\xc0-\xff]", data))
    return ("cp1251" if high > 2 * plain else "cp1252"), 0


def decode_bytes(data: bytes) -> str:
    """Text of bytes in their charset_of, gaps filled."""
    name, mark = charset_of(data)
    return data[mark:].decode(name, "replace")


def pdf_to_text(data: bytes) -> str:
    """Text layer of a PDF, pages apart by a blank line; empty if half of the pages or more have none.

    Content streams are plain or deflated, and strings are literal or hexadecimal in a one-byte Latin encoding; fonts with
    encodings of their own, encrypted files and compressed object streams give no text.
    """
    if not data.startswith(b"%PDF-"):
        raise ValueError("no PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?<!\d)(\d+) \d+ obj\b(.*?)\bendobj", data, re.S)}

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if m is None:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]

    pages = []
    for body in (b for _, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)):
        found = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ \d+ R)", body)
        parts = [stream(objects.get(int(n), b"")) for n in re.findall(rb"(\d+) \d+ R", found[1])] if found else []
        pages.append(pdf_page_text(b"\n".join(parts)))
    if not pages or sum(not p for p in pages) * 2 >= len(pages):
        return ""
    return "\n\n".join(p for p in pages if p)


PDF_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|[A-Za-z'\"][\w*'\"]*", re.S)
# What follows a backslash in a literal string.
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_page_text(content: bytes) -> str:
    """What the text operators of a content stream show, a line for each new line position."""
    def shown(token: bytes) -> str:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
        escaped = lambda m: b"" if m[1] in (b"\n", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else PDF_ESCAPES.get(m[1], m[1])
        return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", escaped, token[1:-1], flags=re.S).decode("cp1252", "replace")

    out: list[str] = []
    for block in re.findall(rb"\bBT\b(.*?)\bET\b", content, re.S):
        operands: list[bytes] = []
        for token in PDF_TOKEN.findall(block):
            if token in (b"Tj", b"TJ", b"'", b'"'):
                if token in (b"'", b'"'):
                    out.append("\n")
                for x in operands:
                    # A wide gap between the strings of an array stands for a blank.
                    out.append(shown(x) if x[:1] in b"(<" else " " if re.fullmatch(rb"-\d{3,}(?:\.\d*)?", x) and token == b"TJ" else "")
            elif token in (b"Td", b"TD", b"T*", b"Tm"):
                moved = token != b"Td" or len(operands) < 2 or float(operands[-1]) != 0
                out.append("\n" if moved else " ")
            if re.fullmatch(rb"[A-Za-z'\"][\w*'\"]*", token):
                operands = []
            else:
                operands.append(token)
        out.append("\n")
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def media_type_of(data: bytes, name: str | None = None) -> str:
    """Media type by leading bytes, then by the name's ending, then text or bytes by content."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    ending = (name or "").rpartition(".")[2].lower()
    if ending in BY_NAME:
        return BY_NAME[ending]
    head = data.lstrip()[:64].lower()
    if head.startswith((b"<!doctype html", b"<html")):
        return "text/html"
    return "application/octet-stream" if b"\0" in data and not data.startswith((b"\xff\xfe", b"\xfe\xff")) else "text/plain"


def _safe(f, x):
    try:
        return None if x is None else f(x)
    except Exception:
        return None


def html_text(source: Column) -> Column:
    """Text of HTML given as text or as bytes in a charset of its own."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _safe(lambda v: html_to_text(decode_bytes(bytes(v)) if isinstance(v, (bytes, bytearray)) else v), x))

    return run(source)


def markdown_text(source: Column) -> Column:
    """Text of Markdown given as text or as bytes in a charset of its own."""
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _safe(lambda v: markdown_to_text(decode_bytes(bytes(v)) if isinstance(v, (bytes, bytearray)) else v), x))

    return run(source)


#: Extractors by media type; further ones may be added by the caller.
EXTRACTORS = {"application/pdf": pdf_to_text, "text/html": lambda b: html_to_text(decode_bytes(b)), "text/markdown": lambda b: markdown_to_text(decode_bytes(b)), "text/plain": decode_bytes}


def extracted(data: Column, media_type: Column, extractors: dict | None = None, most_bytes: int = 200 << 20) -> Column:
    """Struct (status, text): indexed, failed, or unsupported where no extractor takes the media type."""
    known = dict(EXTRACTORS if extractors is None else extractors)

    @F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("text", T.StringType())]))
    def run(blobs: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for blob, kind in zip(blobs, kinds):
            extractor = known.get((kind or "").split(";")[0].strip().lower())
            if extractor is None:
                out.append(("unsupported", None))
                continue
            text = None if blob is None or len(blob) > most_bytes else _safe(extractor, bytes(blob))
            out.append(("indexed" if text is not None else "failed", text))
        return pd.DataFrame(out, columns=["status", "text"])

    return run(data, media_type)
