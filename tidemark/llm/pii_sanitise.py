"""Operator 10: personal data by patterns, and terms that reveal it by their information.

Patterns find e-mail addresses, ip addresses, card and phone numbers: the protected entities.
Entities of one origin form a group: the domain of an address, the first two parts of an ip, the
issuer digits of a card, the country and area code of a phone number. A word is evidence for an
entity (and its group) if it stands in the same line, at most ``REACH`` words away.

Entities, groups, words and their pairs are counted in distinct texts of the whole corpus. An entity
e holds ``log2(N / n(e))`` bits; a word t tells ``log2(P(t|e) / P(t))`` of them. No text is evidence for
itself: ``P(t) = (n(t) - 1) / (N - 1)``, and ``P(t|e) = (n(e,t) - 1 + PRIOR Q) / (n(e) - 1 + PRIOR)`` with Q from
the rest of the group, in the same way smoothed by P(t): ``Q = (n(g,t) - n(e,t) + PRIOR P(t)) / (n(g) -
n(e) + PRIOR)``, or for a word that only one text has with e, ``(n(g,t) - 1 + PRIOR P(t)) / (n(g) - 1 +
PRIOR)``. So an entity of one text is judged by its group, and a word that no other text has with the
group tells nothing. Near e, a word that tells ``GENERALISE_FROM`` of the bits becomes its kind, one that
tells ``REMOVE_FROM`` is removed.

Each task counts what it reads and sends one row per owner and word; texts that may have copies are
first brought down to one of each, the others never move.

Edge cases: null and empty texts have no spans; offsets are code points of the whole text; terms
inside a base span are left to it; repeated rows get equal results; an empty table gives an
empty result; extra columns are kept by ``sanitise`` and ignored by ``detect``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import ddl, lean
from tidemark.llm.spaced_seeds import Bloom, plain_words
from tidemark.llm.words import Texts, mix, slices
from tidemark.session import cut

KINDS = ("email", "ip", "card", "phone")
PRIOR = 1.0  # texts that the rate behind an estimate weighs
REACH = 256  # words of a line that are evidence, on both sides
TALLY = 1 << 18  # terms, or pairs, a task gathers before it counts them
AT_ONCE = 1 << 11  # entities of a text that are paired at once
GENERALISE_FROM, REMOVE_FROM = 0.6, 0.9

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
DIGITS = re.compile("[0-9]+")
ENTITY_HINT = "[0-9@]"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match belongs to one ``@``, its local part reaches left to the end
    of the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def _plain(kind: str, found: str) -> str:
    return found.lower() if kind in ("email", "ip") else "".join(DIGIT.findall(found))


def _id(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, found: str) -> int:
    return _id(f"{kind}:{_plain(kind, found)}")


def group_of(kind: str, found: str) -> str:
    """Domain, first two parts, six issuer digits, or the number up to its area code."""
    plain = _plain(kind, found)
    if kind == "email":
        return plain.rpartition("@")[2]
    if kind == "ip":
        return ".".join(plain.split(".")[:2])
    if kind == "card":
        return plain[:6]
    parts = DIGITS.findall(found)
    return "".join(parts[:2])[: max(len(plain) - 4, 0)] if len(parts) > 2 else plain[: max(len(plain) - 7, 0)]


def _group(kind: str, found: str) -> int:
    return _id(f"group:{kind}:{group_of(kind, found)}")


def _places(text: str, raw: bytes):
    """Words of one text as (fingerprints, start bytes, end bytes)."""
    data = np.frombuffer(raw, np.uint8)
    hasher, words = plain_words(Texts(data, np.array([0, data.size])))
    return hasher.of(words.start, words.end).view(np.int64), words.start, words.end


def _byte_of(raw: bytes) -> np.ndarray:
    """Byte offset of every code point, and of the end."""
    data = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), data.size)


def _evidence(text: str, raw: bytes, spans: list[tuple[str, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entity, group, term) of distinct pairs, for at most ``AT_ONCE`` spans at once: words in no
    base span with the entities of their line within ``REACH`` words."""
    if not spans:
        return
    ids, start, end = _places(text, raw)
    at = _byte_of(raw)
    lo, hi = at[[s[1] for s in spans]], at[[s[2] for s in spans]]
    free = np.zeros(ids.size + 1, np.int64)
    first, last = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi)
    inner = np.maximum(last, first)
    np.add.at(free, first, 1)
    np.add.at(free, inner, -1)
    free = np.cumsum(free)[:-1] == 0
    breaks = np.concatenate(([-1], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), [len(raw)]))
    line = np.searchsorted(breaks, lo, side="right")
    left = np.maximum(np.searchsorted(start, breaks[line - 1]), first - REACH)
    right = np.minimum(np.searchsorted(start, breaks[np.searchsorted(breaks, hi)]), inner + REACH)
    entity = np.array([_entity(k, text[a:b]) for k, a, b in spans], np.int64)
    group = np.array([_group(k, text[a:b]) for k, a, b in spans], np.int64)
    for i in range(0, len(spans), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        size = np.maximum(right[part] - left[part], 0)
        behind = np.cumsum(size) - size
        word = np.arange(int(size.sum())) + np.repeat(left[part] - behind, size)
        of = np.repeat(np.arange(i, i + size.size), size)
        of, word = of[free[word]], word[free[word]]
        owner, theirs, term = entity[of], group[of], ids[word]
        order = np.lexsort((term, owner))
        owner, theirs, term = owner[order], theirs[order], term[order]
        new = np.append(True, (np.diff(owner) != 0) | (np.diff(term) != 0))[: owner.size]
        yield owner[new], theirs[new], term[new]


def _unique_pairs(owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((term, owner))
    owner, term = owner[order], term[order]
    first = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(term) != 0))[: owner.size])
    return owner[first], term[first], np.diff(np.append(first, owner.size))


class Distinct:
    """One row per distinct text. Only texts that may have copies (Bloom filter of bounded size of
    the keys that occur more than once) are shuffled, to keep one of each; the rest is read in place."""

    def __init__(self, docs: DataFrame, texts: DataFrame):
        copied = Bloom.of(texts.filter("n > 1"), "key")
        self.shared = shared = docs.sparkSession.sparkContext.broadcast((int(copied.mask) + 1, copied.words))
        self.docs = docs.select("text", F.xxhash64("text").alias("key"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Bloom(*shared.value)
            for batch in batches:
                hit = held.may_hold(batch.column(1).to_numpy().view(np.uint64))
                yield batch.take(pa.array(hit))

        self.copies = cut(self.docs.mapInArrow(lean(run), "text string, key bigint").dropDuplicates(["key"]))

    def map(self, work, schema: str, hinted: bool = False) -> DataFrame:
        """``work`` gets (texts, keys) of slices of distinct texts and returns record batches."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Bloom(*shared.value)

            def parts():
                for batch in batches:
                    if batch.num_rows and not batch.column(2)[0].as_py():
                        again = np.ones(batch.num_rows, bool)
                        again[held.may_hold(batch.column(1).to_numpy().view(np.uint64))] = False
                        batch = batch.filter(pa.array(again))
                    keys = batch.column(1).to_numpy()
                    for lo, hi, texts in slices(batch.column(0)):
                        yield texts, keys[lo:hi]

            yield from work(parts())

        def read(df: DataFrame, once: bool) -> DataFrame:
            kept = df.filter(F.col("text").rlike(ENTITY_HINT)) if hinted else df
            return kept.select("text", "key", F.lit(once).alias("once")).mapInArrow(lean(run), schema)

        return read(self.docs, False).unionByName(read(self.copies, True))


def owner_counts(source: Distinct) -> DataFrame:
    """(entity, group, n): distinct texts of every entity; and, with a null entity, of every group."""

    def work(parts) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows():
            owner, group, n = _unique_pairs(*(np.concatenate(x) for x in zip(*held)))
            columns = [pa.array(owner, pa.int64(), mask=owner == 0), pa.array(group), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["entity", "group", "n"])

        for texts, keys in parts:
            for i in range(keys.size):
                text = texts.text(i).decode("utf-8", "replace")
                both = {(_entity(k, text[a:b]), _group(k, text[a:b])) for k, a, b in base_spans(text)}
                if both:
                    pairs = np.array(sorted(both | {(0, g) for _, g in both}), np.int64)
                    held.append((pairs[:, 0], pairs[:, 1]))
                    size += len(pairs)
                if size > TALLY:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    found = source.map(work, "entity bigint, group bigint, n bigint", hinted=True)
    return found.groupBy("entity", "group").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, entities: DataFrame, texts: DataFrame, source: Distinct | None = None) -> DataFrame:
    """(entity, term, n_pair): in how many distinct texts each of the entities, or groups, has a word
    as evidence. ``texts`` holds (key, n), the distinct texts.

    A task sends one row per pair; a text of more than ``AT_ONCE`` entities, whose pairs are not all
    held at once, sends them with its key."""
    source = source or Distinct(docs, texts)
    bloom = Bloom.of(entities, "entity")
    shared = docs.sparkSession.sparkContext.broadcast((int(bloom.mask) + 1, bloom.words))
    names = ["entity", "term", "key", "n"]

    def work(parts) -> Iterator[pa.RecordBatch]:
        wanted = Bloom(*shared.value)
        held, size = [], 0

        def rows():
            owner, term, n = _unique_pairs(*(np.concatenate(x) for x in zip(*held)))
            columns = [pa.array(owner), pa.array(term), pa.nulls(owner.size, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        for texts, keys in parts:
            for i in range(keys.size):
                raw = texts.text(i)
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                for entity, group, term in _evidence(text, raw, spans):
                    owner, term = np.concatenate((entity, group)), np.concatenate((term, term))
                    may = wanted.may_hold(owner.view(np.uint64))
                    owner, term, _ = _unique_pairs(owner[may], term[may])
                    if len(spans) > AT_ONCE:
                        many = np.full(owner.size, keys[i]), np.ones(owner.size, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (owner, term, *many)], names)
                        continue
                    held.append((owner, term))
                    size += owner.size
                if size > TALLY:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    found = source.map(work, "entity bigint, term bigint, key bigint, n bigint", hinted=True)
    known = found.join(entities, "entity", "left_semi")
    long = known.filter("key IS NOT NULL").distinct()
    return (
        known.filter("key IS NULL").unionByName(long).groupBy("entity", "term").agg(F.sum("n").alias("n_pair"))
    )


def term_counts(docs: DataFrame, terms: DataFrame, texts: DataFrame, source: Distinct | None = None) -> DataFrame:
    """(term, n_term): in how many distinct texts of the corpus each of the terms occurs; a task
    sends one row per term."""
    source = source or Distinct(docs, texts)
    bloom = Bloom.of(terms, "term")
    shared = docs.sparkSession.sparkContext.broadcast((int(bloom.mask) + 1, bloom.words))

    def work(parts) -> Iterator[pa.RecordBatch]:
        wanted = Bloom(*shared.value)
        ids, n, fresh, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0
        for texts, _ in parts:
            hasher, words = plain_words(texts)
            found = hasher.of(words.start, words.end)
            hit = wanted.may_hold(found)
            found, doc = found[hit], words.doc[hit]
            _, once = np.unique(found ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
            fresh.append(found[once])
            size += once.size
            if size > TALLY:
                ids, n = _added(ids, n, fresh)
                fresh, size = [], 0
                if ids.size > TALLY:
                    yield _counted(ids, n)
                    ids, n = ids[:0], n[:0]
        ids, n = _added(ids, n, fresh)
        if ids.size:
            yield _counted(ids, n)

    # every task sends its own row of a term: first one row per term, then the test of the few that
    # the filter let through by chance
    found = source.map(work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    return found.join(terms, "term", "left_semi")


def _added(ids: np.ndarray, n: np.ndarray, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counted terms with further occurrences counted in."""
    new = np.concatenate([ids[:0], *fresh])
    all_ids, at = np.unique(np.concatenate((ids, new)), return_inverse=True)
    return all_ids, np.bincount(at, np.concatenate((n, np.ones(new.size, np.int64))), all_ids.size).astype(np.int64)


def _counted(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n)], ["term", "n"])


def _level(n_e, n_et, n_g, n_gt, n_t, texts: float):
    """Level of a word by the estimate above; all but ``texts`` are columns."""
    rate = (F.greatest(n_t, n_et, n_gt) - 1) / F.lit(max(texts - 1, 1.0))
    out = F.when(n_et > 1, n_et).otherwise(1), F.when(n_et > 1, n_e).otherwise(1)
    rest = (F.greatest(n_gt - out[0], F.lit(0)) + PRIOR * rate) / (F.greatest(n_g - out[1], F.lit(0)) + PRIOR)
    given = (n_et - 1 + PRIOR * rest) / (n_e - 1 + PRIOR)
    told, held = F.log2(given / rate), F.log2(F.lit(texts) / n_e)
    share = F.when((held > 0) & (rate > 0), told / held).otherwise(0.0)
    return F.when(share >= REMOVE_FROM, 2).when(share >= GENERALISE_FROM, 1).otherwise(0)


def disclosures(docs: DataFrame) -> tuple[DataFrame, DataFrame, Distinct]:
    """((owner, term, level), entities of several texts, the distinct texts): what words tell about
    an entity of several texts, or about the entities of one text of a group; level 1 is
    generalised, 2 removed."""
    distinct = cut(docs.groupBy(F.xxhash64("text").alias("key")).agg(F.count("*").alias("n")))
    texts = float(max(distinct.count(), 1))
    source = Distinct(docs, distinct)
    owners = cut(owner_counts(source))
    # a group of one entity adds nothing, and a word with one text of an owner tells nothing
    several = owners.filter("entity IS NOT NULL").groupBy("group").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    groups = cut(owners.filter("entity IS NULL").join(several, "group").select("group", F.col("n").alias("n_group")))
    entities = owners.filter("entity IS NOT NULL AND n > 1").select("entity", "group", F.col("n").alias("n_entity"))
    wanted = entities.select("entity").union(groups.select("group"))
    pairs = cut(pair_counts(docs, wanted, distinct, source))
    told = pairs.filter("n_pair > 1")
    counts = cut(term_counts(docs, told.select("term").distinct(), distinct, source))
    of_group = cut(
        told.join(groups, told["entity"] == groups["group"]).join(counts, "term")
        .select("group", "term", "n_group", F.col("n_pair").alias("n_gt"), F.col("n_term").alias("n_t"))
    )
    one = F.lit(1)
    by_group = of_group.select(
        F.col("group").alias("owner"), "term",
        _level(one, one, F.col("n_group"), F.col("n_gt"), F.col("n_t"), texts).alias("level"),
    )
    # of entities of several texts, words with several of them, and words their group may tell
    own = pairs.join(entities, "entity")
    known = (
        own.join(of_group, ["group", "term"], "left").join(counts, "term")
        .filter("n_pair > 1 OR n_gt > 1")
        .select(
            F.col("entity").alias("owner"), "term",
            _level(
                F.col("n_entity"), F.col("n_pair"), F.coalesce("n_group", "n_entity"), F.coalesce("n_gt", "n_pair"),
                F.col("n_term"), texts,
            ).alias("level"),
        )
    )
    return cut(by_group.unionByName(known).filter("level > 0")), entities, source


def _told(docs: DataFrame) -> DataFrame:
    """(_key, _terms): for every distinct text with such words, those that reveal an entity of it."""
    found, entities, source = disclosures(docs)
    # both are evenly spread fingerprints, so their exclusive or is one of the pair
    bloom = Bloom.of(found.select(F.col("owner").bitwiseXOR(F.col("term")).alias("pair")), "pair")
    shared = docs.sparkSession.sparkContext.broadcast((int(bloom.mask) + 1, bloom.words))
    names = ["_key", "entity", "owner", "term"]

    def work(parts) -> Iterator[pa.RecordBatch]:
        held = Bloom(*shared.value)
        for texts, keys in parts:
            for i in range(keys.size):
                raw = texts.text(i)
                text = raw.decode("utf-8", "replace")
                for entity, group, term in _evidence(text, raw, base_spans(text)):
                    for owner in (entity, group):
                        own = held.may_hold((owner ^ term).view(np.uint64))
                        if own.size:
                            columns = np.full(own.size, keys[i]), entity[own], owner[own], term[own]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    rows = source.map(work, "_key bigint, entity bigint, owner bigint, term bigint", hinted=True)
    matched = rows.join(found, ["owner", "term"])
    direct = matched.filter("owner = entity")
    by_group = matched.filter("owner != entity").join(entities.select("entity"), "entity", "left_anti")
    worst = (
        direct.select("_key", "term", "level").unionByName(by_group.select("_key", "term", "level"))
        .groupBy("_key", "term").agg(F.max("level").alias("level"))
    )
    # words of the text itself: at most as many as it has
    return worst.groupBy("_key").agg(F.collect_list(F.struct("term", "level")).alias("_terms"))


def _revealing(docs: DataFrame) -> DataFrame:
    """(_id, _key, _terms): the words of every text that reveal an entity of the text."""
    keys = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    return keys.join(_told(docs), "_key").select("_id", "_key", "_terms")


def all_spans(text: str, raw: bytes, terms: list | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, level): base spans by kind and start, then the revealing terms."""
    base = base_spans(text)
    out = [(k, a, b, 0) for k, a, b in base]
    if terms:
        level = {t["term"]: t["level"] for t in terms}
        ids, start, end = _places(text, raw)
        at = _byte_of(raw)
        taken = np.zeros(at.size, np.int64)  # by code point: base spans that begin less those that end
        for _, a, b in base:
            taken[a] += 1
            taken[b] -= 1
        covered = np.concatenate(([0], np.cumsum(np.cumsum(taken) > 0)))
        for i in np.flatnonzero(np.isin(ids, np.array(list(level), np.int64))).tolist():
            a, b = (int(x) for x in np.searchsorted(at, (start[i], end[i])))
            if covered[a] == covered[b]:
                out.append(("term", a, b, level[int(ids[i])]))
    return out


def replace(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """Entities become the name of their kind; terms their kind (level 1) or nothing (2). Of
    overlapping spans the first, and at one start the longest, names the whole stretch."""
    out, at = [], 0
    for kind, a, b, level in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        out.append(text[at:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif level == 1:
            out.append("[NUMBER]" if DIGIT.search(text[a:b]) else "[WORD]")
        at = b
    return "".join(out) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def _apply(docs: DataFrame, keep: list[str], fields: list, make_row) -> DataFrame:
    """``make_row(text, spans)`` for every row, with its revealing terms at hand. Only texts that may
    have such terms (Bloom filter of bounded size) are moved to meet them."""
    told = cut(_told(docs.select("text")))
    bloom = Bloom.of(told, "_key")
    shared = docs.sparkSession.sparkContext.broadcast((int(bloom.mask) + 1, bloom.words))
    names = [f"_k{i}" for i in range(len(keep))]
    inner = pa.schema(fields)
    rows = docs.select(
        *[docs[c].alias(n) for c, n in zip(keep, names)], docs["text"].alias("_text"), F.xxhash64(docs["text"]).alias("_key")
    )
    kept = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def with_terms(batch: pa.RecordBatch, terms) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in slices(batch.column(len(names))):
            made = []
            for i in range(hi - lo):
                raw = texts.text(i)
                text = raw.decode("utf-8", "replace")
                made.append(make_row(text, all_spans(text, raw, terms[lo + i].as_py() if terms is not None else None)))
            arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(names))]
            arrays += [pa.array([r[j] for r in made], f.type) for j, f in enumerate(inner)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *inner.names])

    def chosen(batch: pa.RecordBatch, held: Bloom, inside: bool) -> pa.RecordBatch:
        hit = np.zeros(batch.num_rows, bool)
        hit[held.may_hold(batch.column(len(names) + 1).to_numpy().view(np.uint64))] = True
        return batch.filter(pa.array(hit == inside))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bloom(*shared.value)
        for batch in batches:
            yield from with_terms(chosen(batch, held, False), None)

    def told_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bloom(*shared.value)
        for batch in batches:
            yield chosen(batch, held, True)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from with_terms(batch, batch.column(len(names) + 2))

    schema = f"{kept}, {ddl(inner)}"
    # never a broadcast join: one task would run both functions, and so hold two Python workers
    chosen_rows = rows.mapInArrow(lean(told_of), rows.schema)
    moved = chosen_rows.join(told.hint("merge"), "_key", "left").select(*names, "_text", "_key", "_terms")
    return rows.mapInArrow(lean(plain), schema).unionByName(moved.mapInArrow(lean(met), schema)).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)], *inner.names
    )


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans (base and revealing terms)."""
    fields = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_terms", pa.int64())]

    def row(text, spans):
        base = [s for s in spans if s[0] != "term"]
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        return (*(sum(s[0] == k for s in base) for k in KINDS), digest, _joined(spans), len(spans) - len(base))

    return _apply(docs, ["doc_id"], fields, row)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with entities and revealing terms replaced; ``n_chars``, where present,
    follows the new text; a null text stays null."""
    new = _apply(docs, docs.columns, [("_new", pa.string())], lambda text, spans: (replace(text, spans),))
    new = new.withColumn("_new", F.when(F.col("text").isNotNull(), F.col("_new")))
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("_new")) if "n_chars" in docs.columns else None
    columns = {"text": F.col("_new")} | ({"n_chars": size.cast(docs.schema["n_chars"].dataType)} if size is not None else {})
    return new.withColumns(columns).select(*docs.columns)
