"""Operator 12: Merkle manifest of a dataset, built by slot pivots.

A row is a leaf. The leaves of one language, ascending by doc_id, are folded in runs of ``FANOUT``:
conditional aggregates spread the children of a parent into ``FANOUT`` columns, the hash of the
columns put together is the parent, and the columns without a child's own slot are its siblings.
The roots of all languages, ordered by language, are folded the same way into the root.

Leaves are numbered by range partitioning and one count per (partition, language), so no task sees
a whole language. A level is written once and has an eighth of the rows of the one below. Proofs go
down the tree: a parent's row holds all its children, so a level is one join of parents with their
own paths. The driver sees the size of the largest language and the root.

H is the lower-case hex SHA-256 of its inputs put together. A field is ``-`` if null, else its UTF-8
byte count, ``:`` and its value.

Edge cases: null doc_ids come first, equal doc_ids are ordered by leaf; equal rows are equal leaves.
The null language is one of its own and comes first. A lone leaf is its own subroot; a lone subroot
is the root and a lone leaf in it has the hash of the empty string as its proof's digest. Columns
beyond the five fields are not covered and change nothing. An empty table has no root and no rows.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(**instead: Column) -> Column:
    """The leaf of a row of documents; ``instead`` replaces fields by other values."""
    values = [instead.get(name, F.col(name)).cast("string") for name in FIELDS]
    return hashed(*[
        F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values
    ])


class Tree(NamedTuple):
    """``levels[l]``: parents (grp, pos) with slot columns of the nodes of level l; ``tops``: per
    group grp, height and subroot; ``lone``: leaves that are a subroot themselves."""

    levels: list[DataFrame]
    tops: DataFrame
    lone: DataFrame


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos, their place in grp by ``order``, and n, the nodes of grp."""
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # equal rows may be dealt to several ranges by where they stood: their order doesn't matter
    ordered = (
        nodes.withColumn("_tie", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
        .repartitionByRange(parts, "grp", *order, "_tie")
        .sortWithinPartitions("grp", *order, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ordered = cut(ordered).withColumn("_part", F.shiftright("_at", 33))
    runs = ordered.groupBy("_part", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part",
        "grp",
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_size").over(Window.partitionBy("grp")).alias("n"),
    )
    return ordered.join(runs, ["_part", "grp"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _pivot(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row per parent: slot k of column c is column ``c<k>``."""
    return nodes.groupBy("grp", F.expr(f"pos div {FANOUT}").alias("pos"), "n").agg(
        *[F.expr(f"max(CASE WHEN pos % {FANOUT} = {k} THEN {c} END) AS {c}{k}") for c in columns for k in range(FANOUT)]
    )


def _climb(nodes: DataFrame, carry: list[str]) -> Tree:
    """Fold the numbered ``nodes`` (grp, pos, n, hash and ``carry``) of every group to its subroot."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    lone = nodes.filter("n = 1")
    levels, tops = [], [lone.select("grp", F.lit(0).alias("height"), F.col("hash").alias("subroot"))]
    while most > 1:
        level = cut(_pivot(nodes.filter("n > 1"), ["hash", *(carry if not levels else [])]))
        levels.append(level)
        nodes = level.selectExpr(
            "grp",
            "pos",
            f"(n + {FANOUT - 1}) div {FANOUT} AS n",
            f"sha2(concat({', '.join(f"coalesce(hash{k}, '')" for k in range(FANOUT))}), 256) AS hash",
        )
        tops.append(nodes.filter("n = 1").select("grp", F.lit(len(levels)).alias("height"), F.col("hash").alias("subroot")))
        most = -(-most // FANOUT)
    out = tops[0]
    for more in tops[1:]:
        out = out.union(more)
    return Tree(levels, out, lone)


def _descend(tree: Tree, tops: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, hash, subroot and path (siblings from the leaf upwards) of every leaf.

    ``tops``: per group grp, height, subroot and the path above its subroot."""
    at = None
    for height in range(len(tree.levels), 0, -1):
        start = tops.filter(F.col("height") == height).select("grp", F.lit(0).cast("bigint").alias("pos"), "subroot", "path")
        above = start if at is None else at.union(start)
        level, bottom = tree.levels[height - 1].drop("n"), height == 1
        slots = lambda c: F.array(*[f"{c}{k}" for k in range(FANOUT)]).alias(f"_{c}")
        own = carry if bottom else []
        family = level.select("grp", "pos", *[slots(c) for c in ("hash", *own)]).join(above, ["grp", "pos"])
        family = family.select("*", F.posexplode("_hash").alias("_k", "hash")).filter("hash IS NOT NULL")
        step = f"named_struct('left', concat_ws('', slice(_hash, 1, _k)), 'right', concat_ws('', slice(_hash, _k + 2, {FANOUT})))"
        at = family.selectExpr(
            *(["hash", *[f"_{c}[_k] AS {c}" for c in own]] if bottom else ["grp", f"pos * {FANOUT} + _k AS pos"]),
            "subroot",
            f"concat(array({step}), path) AS path",
        )
    lone = tree.lone.join(tops.filter("height = 0").select("grp", "subroot", "path"), "grp").select(
        "hash", *carry, "subroot", "path"
    )
    return lone if at is None else lone.union(at)


def proofs(leaves: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, hash, subroot, path and root of every row of ``leaves``.

    ``leaves``: grp (orders the groups, never null), doc_id, hash and further columns ``carry``, which
    must be functions of the leaf or doc_id. ``path`` lists the siblings to the left and right of
    the leaf and of every node above it, up to the root."""
    tree = _climb(_numbered(leaves, ["doc_id", "hash"]), carry)
    groups = cut(tree.tops.select(F.lit("").alias("grp"), F.col("subroot").alias("hash"), F.col("grp").alias("of"), "height"))
    upper = _climb(_numbered(groups, ["of"]), ["of", "height"])
    tops = cut(_descend(upper, upper.tops.withColumn("path", F.array().cast(PATH)), ["of", "height"]).select(
        F.col("of").alias("grp"), "height", F.col("hash").alias("subroot"), "path", F.col("subroot").alias("root")
    ))
    root = tops.select("root").first()
    return _descend(tree, tops.drop("root"), carry).withColumn("root", F.lit(root[0] if root else None).cast("string"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: hashed(s["left"], h, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root, digest of the proof, and the root refolded from the row as presented: in
    every third document (by CRC-32 of doc_id) the text's A-Z come back lower-cased."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"),
        "doc_id",
        leaf_of().alias("hash"),
        leaf_of(text=F.when(altered, lowered).otherwise(F.col("text"))).alias("claim"),
    )
    proven = proofs(leaves, ["doc_id", "claim"])
    out = proven.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("claim"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS[:-1]) + " || " + _FIELD.format("{text}") + ")"
# CRC-32 bit by bit: a byte is xored in, then eight shifts (marked -1) follow.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(text=_LOWER)} ELSE {_LEAF.format(text="text")} END AS claim
  FROM documents
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves
), lower AS (
  SELECT grp, 0 AS lvl, pos, n, leaf AS h FROM numbered
  UNION ALL
  SELECT grp, lvl + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM lower WHERE n > 1 GROUP BY grp, lvl, pos // {FANOUT}, n
), subroots AS (
  SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM lower WHERE n = 1
), upper AS (
  SELECT 0 AS lvl, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos))
  FROM upper WHERE n > 1 GROUP BY lvl, pos // {FANOUT}, n
), walk AS (
  SELECT doc_id, leaf, grp, 0 AS lvl, pos AS leaf_pos, pos, n, claim AS h, '' AS proof FROM numbered
  UNION ALL
  SELECT w.doc_id, w.leaf, w.grp, w.lvl + 1, w.leaf_pos, w.pos // {FANOUT}, (w.n + {FANOUT - 1}) // {FANOUT},
         sha256(string_agg(CASE WHEN u.pos = w.pos THEN w.h ELSE u.h END, '' ORDER BY u.pos)),
         w.proof || coalesce(string_agg(CASE WHEN u.pos <> w.pos THEN u.h END, '' ORDER BY u.pos), '')
  FROM walk w JOIN lower u ON u.grp = w.grp AND u.lvl = w.lvl AND u.pos // {FANOUT} = w.pos // {FANOUT}
  WHERE w.n > 1
  GROUP BY w.doc_id, w.leaf, w.grp, w.lvl, w.leaf_pos, w.pos, w.n, w.h, w.proof
), high AS (
  SELECT w.doc_id, w.leaf, w.leaf_pos, s.h AS subroot, w.grp, 0 AS lvl, s.pos, s.n, w.h, w.proof
  FROM walk w JOIN subroots s ON s.grp = w.grp WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.leaf_pos, w.subroot, w.grp, w.lvl + 1, w.pos // {FANOUT}, (w.n + {FANOUT - 1}) // {FANOUT},
         sha256(string_agg(CASE WHEN u.pos = w.pos THEN w.h ELSE u.h END, '' ORDER BY u.pos)),
         w.proof || coalesce(string_agg(CASE WHEN u.pos <> w.pos THEN u.h END, '' ORDER BY u.pos), '')
  FROM high w JOIN upper u ON u.lvl = w.lvl AND u.pos // {FANOUT} = w.pos // {FANOUT}
  WHERE w.n > 1
  GROUP BY w.doc_id, w.leaf, w.leaf_pos, w.subroot, w.grp, w.lvl, w.pos, w.n, w.h, w.proof
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM high, (SELECT h AS root FROM upper WHERE n = 1) WHERE n = 1
"""
