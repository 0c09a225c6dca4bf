"""Operator 11: grouping of spelling variants by blocked Gram matrices of letter counts.

One edit changes the vector of a word's letter counts by a squared length of at most two: an
insertion or deletion by one, a replacement by two. So candidates come from products of count
matrices: |a|^2 + |b|^2 - 2ab for all words of two blocks at once, in NumPy. A block holds the words
with equal counts of ``GROUPS`` letter groups (and so of one length); one edit leads to the same
block or to one in which one group has a letter more and at most one other a letter less. Only such
pairs of blocks meet. A large block is cut into chunks by a hash, so a product has bounded size
however many words share a block; only pairs within the distance leave a task, after the edit is
verified on the letters.

Words are counted per task before they are shuffled. Forms point to a word at least five times as
frequent, so chains are short and free of cycles: pointers are doubled until none moves.

Edge cases: a null text has no words, a null doc_id is written as an empty string before the colon.
Repeated rows count as often as they occur. Words of any length are compared whole; chunks are
also bounded in letters. Of equally frequent near words the form is the smallest in code-point
order. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_TIMES = 5
NOISE = 199
CHUNK_WORDS = 256
CHUNK_LETTERS = 1 << 16
HELD_WORDS = 300_000

ALPHABET = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
GROUPS = 5
_RUN = re.compile("[a-zÀ-ÿ]+")
_INDEX = np.zeros(0x100, np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _letter_groups() -> list[str]:
    """The alphabet dealt to groups of about equal use: letters by falling frequency, back and forth."""
    order = "esiarntolucdmphgvfbqzxjkyw"
    ranked = [*order, *(c for c in ALPHABET if c not in order)]
    turn = [*range(GROUPS), *reversed(range(GROUPS))]
    return ["".join(c for i, c in enumerate(ranked) if turn[i % len(turn)] == g) for g in range(GROUPS)]


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


def noisy(doc_id: str, run: str, noise: int = NOISE) -> str:
    """The run as it enters the counts: without one letter where ``noise`` divides its checksum."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, noise: int = NOISE) -> DataFrame:
    """(word, n): occurrences in all texts of the words of at least ``least_length`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Counter(_RUN.findall(lower_ascii(text.as_py() or "")))
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in words.items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), before)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def one_edit_apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of letter matrices a (m x L) and b (k x M), |L - M| <= 1, that are one edit apart.

    A product of letter counts leaves the pairs at squared distance two or less; the common start
    and the common end of a pair then decide."""
    width = len(ALPHABET)
    exact = np.float32 if max(a.shape[1], b.shape[1]) < 2048 else np.float64  # squares stay exact
    both = [np.bincount((np.arange(x.shape[0])[:, None] * width + x).ravel(), minlength=x.shape[0] * width) for x in (a, b)]
    counts = [x.reshape(-1, width).astype(exact) for x in both]
    used = counts[0].any(axis=0) | counts[1].any(axis=0)
    ca, cb = (x[:, used] for x in counts)
    gap = ca @ cb.T
    gap *= -2
    gap += (ca * ca).sum(axis=1)[:, None]
    gap += (cb * cb).sum(axis=1)[None, :]
    i, j = np.nonzero(gap <= 2)
    short = min(a.shape[1], b.shape[1])
    step = max(1, (1 << 22) // max(short, 1))
    keep = np.zeros(i.size, bool)
    for lo in range(0, i.size, step):
        x, y = a[i[lo : lo + step]], b[j[lo : lo + step]]
        if x.shape[1] == y.shape[1]:
            keep[lo : lo + step] = (x != y).sum(axis=1) == 1
        else:
            start = np.cumprod(x[:, :short] == y[:, :short], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            end = x[:, x.shape[1] - short :] == y[:, y.shape[1] - short :]
            end = np.cumprod(end[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            keep[lo : lo + step] = start + end >= short
    return i[keep], j[keep]


def _matrix(words: pa.Array) -> np.ndarray:
    """Letter numbers of words of one length, one word per row."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    return _INDEX[flat].reshape(len(words), -1)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, words, other words) of two chunks -> (word, near, near_n), both ways."""
    for batch in batches:
        sides = []
        for column in (batch.column(1), batch.column(2)):
            items = column.flatten()
            sides.append((column.value_lengths().to_numpy(), items.field(0), items.field(1)))
        same = batch.column(0).to_pylist()
        (na, wa, ca), (nb, wb, cb) = sides
        ends = np.cumsum(na), np.cumsum(nb)
        left, right = [], []
        for r in range(batch.num_rows):
            la, lb = int(ends[0][r] - na[r]), int(ends[1][r] - nb[r])
            i, j = one_edit_apart(_matrix(wa.slice(la, int(na[r]))), _matrix(wb.slice(lb, int(nb[r]))))
            if same[r]:
                i, j = i[i < j], j[i < j]
            left.append(i + la)
            right.append(j + lb)
        i, j = (pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (left, right))
        yield pa.RecordBatch.from_arrays([wa.take(i), wb.take(j), cb.take(j)], ["word", "near", "near_n"])
        yield pa.RecordBatch.from_arrays([wb.take(j), wa.take(i), ca.take(i)], ["word", "near", "near_n"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words of ``vocabulary`` (word, n) that are one edit apart, both
    ways. Words consist of letters of ``ALPHABET``."""
    sizes = [f"char_length(word) - char_length(translate(word, '{g}', ''))" for g in _letter_groups()]
    names = [f"g{i}" for i in range(GROUPS)]
    words = vocabulary.select("word", "n", *[F.expr(s).alias(c) for s, c in zip(sizes, names)])
    words = words.withColumn("block", F.concat_ws(",", *names))
    blocks = words.groupBy("block", *names).agg(
        F.greatest(
            F.ceil(F.count("*") / CHUNK_WORDS), F.ceil(F.sum(F.char_length("word")) / CHUNK_LETTERS)
        ).alias("chunks")
    )
    blocks = cut(blocks)

    def moved(up=None, down=None):
        return "concat_ws(',', " + ", ".join(f"{c} {'+ 1' if i == up else '- 1' if i == down else ''}" for i, c in enumerate(names)) + ")"

    steps = [moved(), *(moved(i) for i in range(GROUPS))]
    steps += [moved(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    reach = blocks.select("block", "chunks", F.explode(F.expr(f"array({', '.join(steps)})")).alias("other"))
    others = blocks.select(F.col("block").alias("other"), F.col("chunks").alias("other_chunks"))
    meetings = (
        reach.join(others, "other")
        .withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        .withColumn("other_chunk", F.explode(F.expr("sequence(0L, other_chunks - 1)")))
        .filter("block <> other OR chunk <= other_chunk")
        .select("block", "chunk", "other", "other_chunk")
    )
    spread = words.join(blocks.select("block", "chunks"), "block")
    chunks = cut(
        spread.groupBy("block", F.expr("pmod(xxhash64(word), chunks)").alias("chunk"))
        .agg(F.collect_list(F.struct("word", "n")).alias("words"))
    )
    far = chunks.select(F.col("block").alias("other"), F.col("chunk").alias("other_chunk"), F.col("words").alias("other_words"))
    pairs = meetings.join(chunks, ["block", "chunk"]).join(far, ["other", "other_chunk"])
    pairs = pairs.select(F.expr("block = other AND chunk = other_chunk").alias("same"), "words", "other_words")
    return pairs.mapInArrow(_meet, "word string, near string, near_n bigint")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of all rows of ``forms`` (word, form): the last word that forms lead to.

    Every round doubles the steps that a pointer covers, until no pointer moves."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if not at.filter("_moved").limit(1).count():
            return at.select("word", "root")
        at = at.drop("_moved")


def spelling_groups(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    form_times: int = FORM_TIMES,
    noise: int = NOISE,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every frequent word of all texts."""
    vocabulary = cut(count_words(docs, least_length, noise).filter(F.col("n") >= least_count))
    near = near_words(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best")
    )
    fits = -F.col("_best.m") >= form_times * F.col("n")
    judged = cut(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(fits, F.col("_best.near")).alias("form"),
            F.when(fits, -F.col("_best.m")).alias("form_n"),
        )
    )
    roots = follow(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase
_SHIFTS = ", ".join(["-1"] * 8)
# CRC-32 bit by bit over UTF-8 bytes: a byte is xored in, then eight shifts (marked -1) follow.
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''), lambda c:
  CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT, {_SHIFTS}]
  ELSE [195::BIGINT, {_SHIFTS}, unicode(c) - 64, {_SHIFTS}] END))),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{_UP}', '{_LOW}') AS w
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), summed AS (
  SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS key, count(*) AS k FROM runs
  WHERE length(w) >= {LEAST_LENGTH} GROUP BY doc_id, w
), checked AS (
  SELECT w, k, {_CRC} AS h FROM summed
), entered AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k
  FROM checked
), vocabulary AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM entered
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}
), shorter AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)
), near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.less = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.less = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word
), judged AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= {FORM_TIMES} * v.n THEN near END AS form,
         CASE WHEN near_n >= {FORM_TIMES} * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word
), walk AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL
  SELECT w.word, j.word, j.form FROM walk w JOIN judged j ON j.word = w.next
)
SELECT j.word, form, root, n, n_near, form_n FROM judged j JOIN walk w ON w.word = j.word AND w.next IS NULL
"""
