"""Cutting oversized texts at natural boundaries with bounded-quantifier regexes and array functions.

A text becomes a code string with one sign a word that tells how strong the boundary after the word is. One pattern
of ordered alternatives with bounded quantifiers then takes as many words as the limit allows: up to the last boundary
before a heading, else a paragraph, list item, sentence or line end in the second half, else, sign by sign, just up to
the limit. Looking back from each cut by the overlap gives the next piece's start.

Defined cases: a null text gives null pieces, an empty or blank text none; a text within the limit is one piece; a null
or non-positive limit leaves the text whole; a null or negative overlap is 0 and one of the limit or more is the limit
less one. Pieces keep all signs between their words, and the pieces without their overlaps make up the whole text.
Broken UTF-8 becomes U+FFFD, broken UTF-16 units are dropped. Repeated rows are cut alike; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space between words, as TESTDATA.md names it, and the signs of the code string.
BLANKS = r" \t\n\r"
HEADING, PARAGRAPH, ITEM, SENTENCE, LINE, WORD = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06"
CODES = HEADING + PARAGRAPH + ITEM + SENTENCE + LINE + WORD
# What a heading and a list item begin with in HTML, Markdown, wiki and LaTeX sources.
HEADING_START = r"(?:#{1,6}[ \t]|={1,6}|<[hH][1-6]|\\(?:part|chapter|(?:sub){0,2}section|paragraph)\b)"
ITEM_START = r"(?:[-*+•#:;]+[ \t]|\d{1,3}[.)][ \t]|<(?:li|LI|tr|TR)\b|\\item\b)"
UNIT = rf"^[{BLANKS}]*[^{BLANKS}]+[{BLANKS}]*|[^{BLANKS}]+[{BLANKS}]*"


def boundary_codes(text: Column) -> Column:
    """One sign a word of ``text``: the strength of the boundary after it.

    White space between words turns into signs, the strongest first, and the words then vanish; each pass is linear.
    """
    line = rf"[ \t]*+[\r\n][{BLANKS}]*+"
    body = F.trim(F.translate(text, CODES, "______"), F.lit(" \t\n\r"))
    out = F.when(body == "", body).otherwise(F.concat(body, F.lit(WORD)))
    for pattern, code in (
        (rf"{line}(?={HEADING_START})", HEADING),
        (rf"[ \t]*+(?:\r\n|\n|\r)[ \t]*+[\r\n][{BLANKS}]*+", PARAGRAPH),
        (rf"{line}(?={ITEM_START})", ITEM),
        # The sign before the white space is looked at before the longer way back is.
        (rf"(?=[{BLANKS}])(?<=[.!?…。！？\"')\]}}»”’*_>])[{BLANKS}]++(?<=[.!?…。！？][\"')\]}}»”’*_]{{0,4}}(?:</[a-zA-Z0-9]{{1,9}}>)?[{BLANKS}]{{1,9}})", SENTENCE),
        (line, LINE),
        (rf"[{BLANKS}]++", WORD),
        (r"[^\x01-\x06]++", ""),
    ):
        out = F.regexp_replace(out, pattern, code)
    return out


def ends_of_pieces(codes: Column, limit: Column, overlap: Column) -> Column:
    """Number of words up to each piece's end, by the ordered alternatives of one pattern."""
    any_sign = "[\\x01-\\x06]"

    def part(most: Column, least: Column) -> Column:
        some = F.concat(F.lit(any_sign + "{"), least, F.lit(","), most, F.lit("}"))
        at = [F.concat(some, F.lit(f"(?<=[\\x01-\\x0{k}])")) for k in range(1, 6)]
        return F.concat(F.lit("(?:" + any_sign + "{1,"), most, F.lit("}$|"), F.concat_ws("|", *at), F.lit("|" + any_sign + "{1,"), most, F.lit("})"))

    step = limit - overlap
    half = lambda n: F.ceil(n / 2).cast("int")
    first = part(limit.cast("string"), F.least(limit, F.greatest(half(limit), overlap + 1)).cast("string"))
    # Every cut lies behind the overlap, so the lookback stays within the text.
    later = part(step.cast("string"), half(step).cast("string"))
    first = F.when(overlap >= limit - 1, part(limit.cast("string"), limit.cast("string"))).otherwise(first)
    taken = F.regexp_extract_all(codes, F.concat(F.lit("^"), first, F.lit("|(?<!^)"), later), F.lit(0))
    sums = F.aggregate(taken, F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at")), lambda a, x: F.struct(F.array_append(a["ends"], a["at"] + F.length(x)).alias("ends"), (a["at"] + F.length(x)).alias("at")))
    return sums["ends"]


def with_pieces(df: DataFrame, text: str, limit: str, overlap: str, out: str = "pieces", words: str = "n_words") -> DataFrame:
    """df with its number of words and an array of pieces (start word from 0, end word, text)."""
    size = F.col(limit).cast("int")
    size = F.when(size > 0, size)
    back = F.least(F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)), size - 1)
    codes = df.withColumn("__codes", boundary_codes(F.col(text)))
    codes = codes.withColumn(words, F.length("__codes"))
    ends = F.when(F.col(words).isNull(), F.lit(None)).when(F.col(words) == 0, F.array().cast("array<int>")).when(size.isNull() | (F.col(words) <= size), F.array(F.col(words))).otherwise(ends_of_pieces(F.col("__codes"), size, back))
    codes = codes.withColumn("__ends", ends)
    # Words are only taken apart where there is more than one piece.
    codes = codes.withColumn("__units", F.when(F.size("__ends") > 1, F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).otherwise(F.array(text)))

    def piece(end: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("__ends"), i - 1) - back)
        return F.struct(start.alias("start"), end.alias("end"), F.when(F.size("__ends") == 1, F.get("__units", F.lit(0))).otherwise(F.array_join(F.slice(F.col("__units"), start + 1, end - start), "")).alias("text"))

    return codes.withColumn(out, F.transform("__ends", piece)).drop("__codes", "__ends", "__units")


def decoded(blob: Column, charset: Column) -> Column:
    """Text of ``blob`` in UTF-8 (or null), iso-8859-1 or utf-16le, without a byte order mark; never fails."""
    # One UTF-16LE unit pair in hexadecimal, a plain unit or a high surrogate and a low one.
    pair = r"[0-9A-F]{2}(?:[0-9ABCEF][0-9A-F]|D[0-7])|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[CDEF]"
    whole = F.unhex(F.regexp_replace(F.hex(blob), rf"\G({pair})|\G(?:[0-9A-F]{{4}}|[0-9A-F]{{2}}$)", "$1"))
    name = F.lower(F.trim(charset))
    text = F.when(name == "iso-8859-1", F.decode(blob, "ISO-8859-1")).when(name == "utf-16le", F.decode(whole, "UTF-16LE")).otherwise(F.make_valid_utf8(blob.cast("string")))
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def text_items(items: DataFrame) -> DataFrame:
    """The rows of work items whose files are no binaries; a missing hash is made from the bytes."""
    kind = F.lower(F.trim(F.split_part(F.coalesce("media_type", F.lit("")), F.lit(";"), F.lit(1))))
    return items.where((kind != "application/octet-stream") & F.col("blob_bytes").isNotNull()).withColumn("sha256", F.coalesce("sha256", F.sha2("blob_bytes", 256)))


def file_texts(items: DataFrame, results: DataFrame) -> DataFrame:
    """(sha256, text): the text of each file once, however often it is queued, in the charset found for it, else UTF-8."""
    # Results that name no charset say UTF-8.
    charset = F.coalesce(F.lower(F.trim("charset")), F.lit("utf-8"))
    charsets = results.where("sha256 is not null").groupBy("sha256").agg(F.min(F.when(charset.isin("utf8", "utf-8"), F.lit("utf-8")).otherwise(charset)).alias("charset"))
    files = text_items(items).groupBy("sha256").agg(F.first("blob_bytes").alias("bytes"))
    return files.join(charsets, "sha256", "left").select("sha256", decoded(F.col("bytes"), F.col("charset")).alias("text"))


def pieces_of_files(items: DataFrame, results: DataFrame) -> DataFrame:
    """(item_id, sha256, piece, start_word, end_word, text) of every distinct work item that holds a text.

    A file is cut once for each of its settings; what its items share is joined to them by its hash alone, by which the
    texts are spread already.
    """
    queued = text_items(items).select("item_id", "sha256", "chunk_size", "chunk_overlap").distinct()
    settings = queued.select("sha256", F.col("chunk_size").alias("size"), F.col("chunk_overlap").alias("overlap")).distinct()
    cutup = with_pieces(settings.join(file_texts(items, results), "sha256"), "text", "size", "overlap")
    # The outer form keeps the optimizer from inferring a filter that would compute the pieces twice.
    pieces = cutup.select("sha256", "size", "overlap", F.posexplode_outer("pieces").alias("n", "p")).where("n is not null")
    out = queued.join(pieces, "sha256").where(F.col("size").eqNullSafe(F.col("chunk_size")) & F.col("overlap").eqNullSafe(F.col("chunk_overlap")))
    return out.select("item_id", "sha256", (F.col("n") + 1).alias("piece"), F.col("p.start").alias("start_word"), F.col("p.end").alias("end_word"), F.col("p.text").alias("text"))


def oversized_items(pieces: DataFrame) -> DataFrame:
    """(item_id) of the items that needed more than one piece."""
    return pieces.where("piece = 2").select("item_id").distinct()
