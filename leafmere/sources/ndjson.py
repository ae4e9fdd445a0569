"""Documents in NDJSON: reading, importing with a rule for conflicts, dumps of several collections, export.

A document row is (_id string, doc VARIANT). Blank lines are skipped; a line that is no JSON object, or has no string
``_id`` where one is needed, is an error row in ``read_lines`` and raises in ``imported``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmere.functions.keys import new_keys
from leafmere.operators.cutting import cut
from leafmere.operators.log import comparable
from leafmere.operators.running import running


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, _id, doc, error, at) of every line that is not blank; ``at`` orders lines by file and place."""
    # Numbers ascend within a part of a file, and its start orders the parts.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", at.alias("at")).where("trim(value) <> ''")
    doc = F.try_parse_json("value")
    kind = F.schema_of_variant(doc)
    name = F.try_variant_get(doc, "$._id", "string")
    error = F.when(doc.isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object").when(name.isNull(), "no _id")
    return lines.select(F.col("value").alias("line"), name.alias("_id"), doc.alias("doc"), error.alias("error"), "at")


def sound_lines(lines: DataFrame) -> DataFrame:
    """The lines, none of which may have an error."""
    bad = lines.where("error is not null").select("error", F.substring("line", 1, 80).alias("line")).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{b.error}: {b.line}" for b in bad))
    return lines


def one_line_a_key(lines: DataFrame, last: bool = True) -> DataFrame:
    """The last line of each key, or the first."""
    best = F.max_by if last else F.min_by
    return lines.groupBy("_id").agg(best(F.struct("line", "doc", "at"), F.col("at")).alias("v")).select("_id", "v.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(_id, doc); malformed lines are left out."""
    return read_lines(spark, path).where("error is null").select("_id", "doc")


def read_new_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(_id, doc) with new keys, from NDJSON lines or, with ``multiline``, from files that hold one object or an array."""
    if multiline:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        docs = whole.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).alias("doc"))
    else:
        docs = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json("value").alias("doc"))
    return docs.where("doc is not null").select(new_keys().alias("_id"), "doc")


def imported(existing: DataFrame, incoming: DataFrame, on_conflict: str = "replace") -> DataFrame:
    """The collection after an import: the incoming document, the existing one or an error where both have a key.

    Both are (_id, ...) of the same columns; ``incoming`` may have a column ``at`` besides that orders its rows. Of several of one key
    the last counts, under ``ignore`` the first; without an order the greatest.
    """
    rest = [c for c in incoming.columns if c not in ("_id", "at")]
    order = F.col("at") if "at" in incoming.columns else F.struct(*comparable(incoming, rest))
    best = (F.min_by if on_conflict == "ignore" else F.max_by)(F.struct(*rest), order)
    incoming = incoming.groupBy("_id").agg(best.alias("v")).select("_id", "v.*").select(*existing.columns) if rest else incoming.select("_id").distinct()
    if on_conflict == "replace":
        return existing.join(incoming.select("_id"), "_id", "left_anti").unionByName(incoming)
    if on_conflict == "ignore":
        return existing.unionByName(incoming.join(existing.select("_id"), "_id", "left_anti"))
    if on_conflict != "error":
        raise ValueError(f"unknown rule {on_conflict}")
    if not incoming.join(existing.select("_id"), "_id", "left_semi").isEmpty():
        raise ValueError("a document with this key exists")
    return existing.unionByName(incoming)


def restored(lines: DataFrame, line: str = "line", at: str = "n", file: str | None = None) -> DataFrame:
    """(collection, line) of the documents of dumps: the last ``# collection: name`` header before a line names its
    collection; other lines that begin with # and blank ones are left out. A document before any header has a null one.

    lines: the text of each line and its place in its file. A dump's lines are ordered within a file, and spread over ranges of
    their order, so that no task holds a file.
    """
    body = F.trim(F.col(line))
    header = F.when(body.rlike(r"^#\s*collection:"), F.trim(F.regexp_replace(body, r"^#\s*collection:", "")))
    place = F.col(at)
    rows = lines.select(*([F.col(file).alias("__file")] if file else []), place.alias("__at"), F.col(line).alias("line"), F.when(header.isNotNull(), F.struct(place.alias("at"), header.alias("name"))).alias("__head"))
    named = running(rows, ["__file"] if file else [], [F.col("__at").asc()], {"__last": ("max", "__head")})
    bare = F.trim("line")
    return named.where((bare != "") & ~bare.startswith("#")).select(F.col("__last.name").alias("collection"), "line")


def restore_file(spark: SparkSession, path: str) -> DataFrame:
    """(collection, _id, doc) of dump files, line by line, whatever the size of a collection."""
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), at.alias("at"))
    # The places are fixed before they are sorted by.
    found = restored(cut(lines), "line", "at", "file").select("collection", F.try_parse_json("line").alias("doc"))
    docs = found.where("doc is not null and schema_of_variant(doc) like 'OBJECT%'")
    return docs.select("collection", F.try_variant_get("doc", "$._id", "string").alias("_id"), "doc")


def lines_of(docs: DataFrame) -> DataFrame:
    """(value): each document as a JSON line, ``_id`` included; from typed columns or (_id, doc)."""
    if docs.columns == ["_id", "doc"]:
        bare = F.to_json("doc")
        inner = F.regexp_replace(bare, r"^\{", "")
        whole = F.concat(F.lit('{"_id":'), F.to_json(F.array("_id")).substr(F.lit(2), F.length(F.to_json(F.array("_id"))) - 2), F.when(inner == "}", "").otherwise(","), inner)
        has = F.try_variant_get("doc", "$._id", "string").isNotNull()
        return docs.select("_id", F.when(has, bare).otherwise(whole).alias("value"))
    return docs.select(docs.columns[0], F.to_json(F.struct(*docs.columns)).alias("value"))


def export(docs: DataFrame, path: str) -> None:
    """Key-ordered NDJSON files: ranges of keys in files in order."""
    key = docs.columns[0]
    lines_of(docs).orderBy(key).select("value").write.mode("overwrite").text(path)


def dump(collections: dict[str, DataFrame], path: str) -> None:
    """A folder with a dump file set a collection, each document under its header."""
    for name, docs in sorted(collections.items()):
        body = lines_of(docs).orderBy(docs.columns[0]).select(F.concat(F.lit(f"# collection: {name}\n"), F.col("value")).alias("value"))
        body.write.mode("overwrite").text(f"{path}/{name}")
