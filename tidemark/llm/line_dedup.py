"""Operator 13: line deduplication across documents, with DataFrame functions only.

Every normalised line is exploded and hashed, the distinct documents of each hash are counted, and
the lines of a hash that reaches the threshold go from every document but one. Lines are then put
together again by position. Documents are counted on (hash, document) before they meet on the hash,
so a line of a third of all documents sends a few partial counts per task; its rows meet the verdict
in a join that can be split. A text moves once, to meet the positions of its dropped lines.

A line is what lies between two ``\\n``; its key is the line without ``[\\x20\\x09-\\x0D]`` at both ends,
A-Z lower-cased. Keys are compared by 128 bits of their SHA-256.

Edge cases: a null or empty text is one empty line. Rows of one doc_id are one document: they count
once, and all of them keep the line if theirs is the largest doc_id holding it. A null doc_id counts
as no document and keeps no line that reaches the threshold. A text that loses all its lines is
empty. Repeated rows stay and are treated alike; other columns pass through ``drop_repeated_lines``
untouched, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
SPACE = " \t\n\x0b\x0c\r"


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def _keys(text: Column) -> Column:
    """Keys of all lines of a text, in order."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(folded, "\n"), lambda line: F.btrim(line, F.lit(SPACE)))


def repeated_keys(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(key, n_documents, keeper) of all keys found in ``least_documents`` documents or more."""
    keys = F.filter(_keys(F.coalesce("text", F.lit(""))), lambda key: F.char_length(key) >= least_chars)
    lines = docs.select(F.col("doc_id"), F.explode(keys).alias("_line"))
    holders = lines.select(_digest(F.col("_line")).alias("key"), "doc_id").distinct()
    counts = holders.groupBy("key").agg(F.count("doc_id").alias("n_documents"), F.max("doc_id").alias("keeper"))
    return counts.filter(F.col("n_documents") >= least_documents)


def _dropped_positions(
    docs: DataFrame, least_chars: int, least_documents: int
) -> DataFrame:
    """(doc_id, text digest, positions) of the lines that go; texts that keep all lines are absent."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", _digest(text).alias("_text"), F.posexplode(_keys(text)).alias("_pos", "_line"))
    lines = lines.filter(F.char_length("_line") >= least_chars).select(
        "doc_id", "_text", "_pos", _digest(F.col("_line")).alias("key")
    )
    found = lines.join(repeated_keys(docs, least_chars, least_documents), "key")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "_text").agg(F.collect_set("_pos").alias("_gone"))


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """(row, text, n_lines, n_dropped): every row of ``docs`` as a struct, and its text without the
    lines that at least ``least_documents`` documents share."""
    text = F.coalesce("text", F.lit(""))
    gone = _dropped_positions(docs.select("doc_id", "text"), least_chars, least_documents)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), text.alias("_old"), _digest(text).alias("_of"))
    met = rows.join(gone, rows["_id"].eqNullSafe(gone["doc_id"]) & (rows["_of"] == gone["_text"]), "left")
    n_lines = F.char_length("_old") - F.char_length(F.replace("_old", F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("_gone"))
    # the array of one array binds the lines once, so that picking n of them takes n steps
    picked = F.transform(F.array(F.split("_old", "\n")), lambda lines: F.transform(stay, lambda i: lines[i]))[0]
    return met.select(
        "row",
        F.when(F.col("_gone").isNull(), F.col("_old")).otherwise(F.array_join(picked, "\n")).alias("text"),
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the digest of what stays."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_CHARS = " || ".join(f"chr({ord(c)})" for c in SPACE)
ORACLE = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_CHARS}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM split
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone
  FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
