"""Spelling variants, Merkle manifest and line deduplication against plain Python, and edge cases."""

import collections
import hashlib
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import line_dedup, merkle_manifest, spelling_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def frame(spark, rows, extra=True):
    df = spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)
    if not extra:
        return df
    return df.selectExpr("*", "1 AS word", "'x' AS _line", "2 AS n_lines", "'k' AS hash", "5 AS grp", "7 AS _gone", "8 AS key")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11


def brute_groups(rows, least_length=6, least_count=5, times=5, noise=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    v = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}
    near = {w: [x for x in v if one_edit(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        if best and v[best] >= times * v[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), v[w], len(near[w]), v.get(form.get(w))) for w in v}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_groups_match_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 9))) for _ in range(250)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "s", "É"]) for _ in range(400))) for i in range(12)]
    rows += [(40, "banana " * 4000 + "banane " * 700 + "bananes " * 130 + "bananés " * 25 + "Bananésx " * 5)]
    rows += [(None, "Strasse STRASSE strasse straße strässe " * 5), (7, None), (8, ""), (40, "banana"), (40, "banana")]
    assert spelled(spelling_groups.spelling_groups(frame(spark, rows), noise=7)) == brute_groups(rows, noise=7)
    want = brute_groups(rows)
    assert spelled(spelling_groups.spelling_groups(frame(spark, rows))) == want
    assert want["bananésx"][1] == "banana"  # a chain of four forms
    assert spelling_groups.spelling_groups(empty(spark)).count() == 0


def test_blocks_that_are_cut_into_chunks_lose_no_pair(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([9, 10, 11]))) for _ in range(1200)})
    words += ["x" * 3000 + "abc", "x" * 3000 + "abd", "x" * 2999 + "abc", "y" * 70_000, "y" * 70_001]
    monkeypatch.setattr(spelling_groups, "CHUNK_WORDS", 16)
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = collections.Counter((r.word, r.near) for r in spelling_groups.near_words(vocabulary).collect())
    assert set(got.values()) == {1}
    assert set(got) == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def test_one_edit_apart_by_products():
    rng = np.random.default_rng(3)
    for la, lb in ((6, 6), (6, 7), (7, 6), (1, 2)):
        a, b = (rng.integers(0, 3, (40, n)) for n in (la, lb))
        i, j = spelling_groups.one_edit_apart(a, b)
        want = {(x, y) for x in range(40) for y in range(40) if one_edit(a[x].tolist(), b[y].tolist())}
        assert set(zip(i.tolist(), j.tolist())) == want


# 12


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars) in any order; -> sorted result rows."""

    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def lower(r):
        third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        return leaf(r, r[1].translate(FOLD) if third and r[1] is not None else r[1])

    def climb(nodes):
        """(top, siblings of every node from below)"""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, p in enumerate(at):
                run = level[p // 8 * 8 : p // 8 * 8 + 8]
                paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
            level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
            at = [p // 8 for p in at]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[lang] = own, *climb([leaf(r, r[1]) for r in own])
    root, upper = climb([trees[x][1] for x in langs])
    out = []
    for lang, above in zip(langs, upper):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            h = lower(r)
            for before, after in path + above:
                h = H(*before, h, *after)
            proof = H(*[x for before, after in path + above for x in (*before, *after)])
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1, 9], [70, 3, 1, 2, 5, 600, 1, 1, 1, 64]])
def test_manifest_matches_plain_folding(spark, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "", "en", "é", "-", "EN", "z", "en ", "日本", "a"]
    rows, doc_id = [], 0
    for lang, n in zip(langs, sizes):
        for _ in range(n):
            doc_id += rng.randrange(1, 4)
            rows.append((doc_id, rng.choice(["Text É", "lower", "", None, "1:2"]), lang, rng.choice([None, "s"]), rng.choice([None, 7])))
    rng.shuffle(rows)
    got = merkle_manifest.manifest(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows)


def test_manifest_edges(spark):
    rows = [(None, "A", "en", None, None), (None, "A", "en", None, None), (3, "B" * 200_000, "en", "x", 1)]
    rows += [(3, "B", "en", "x", 1)] * 300 + [(4, None, None, None, None)]
    got = merkle_manifest.manifest(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows)
    assert merkle_manifest.manifest(empty(spark)).count() == 0


# 13


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    keyed = [(d, [(x, x.strip(space).translate(FOLD)) for x in (t or "").split("\n")]) for d, t in rows]
    holders = collections.defaultdict(set)
    for doc_id, lines in keyed:
        for _, key in lines:
            if len(key) >= 20 and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, lines in keyed:
        kept = [x for x, key in lines if len(holders.get(key, ())) < 3 or doc_id == max(holders[key])]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_matches_plain_reading(spark):
    rng = random.Random(9)
    pool = [f"line number {i} of the shared ones É" for i in range(30)] + ["short", "", "x" * 19, "y" * 20, "é" * 20, "\x1cfile separator stays inside"]
    dress = lambda x: rng.choice([x, x.upper() if x.isascii() else x, f" \t{x}\r", f"{x}\x0b\x0c "])
    rows = [(i, "\n".join(dress(rng.choice(pool)) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (5, rows[5][1]), (5, "another text of document five\n" + pool[3]), (None, pool[3] + "\nstays")]
    rows += [(70, "\n".join(f"own line {i} that nobody else has" for i in range(50_000)) + "\n" + pool[4])]
    got = line_dedup.line_report(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)
    kept = line_dedup.drop_repeated_lines(frame(spark, rows))
    assert kept.select("row.*").columns == frame(spark, rows).columns and kept.count() == len(rows)
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_line_dedup_needs_no_python(spark):
    plan = line_dedup.line_report(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# SQL


@pytest.mark.parametrize("name", ["op11_spelling_groups", "op12_merkle_manifest", "op13_line_dedup"])
def test_queries_match_their_sql(spark, sf, name):
    from check import canonical
    from tidemark.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert canonical(QUERIES[name](spark, sf).toPandas()).equals(canonical(con.execute(ORACLES[name]).df()))


# shared words


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_defeat_polynomial_sums_stay_apart(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from tidemark.llm import byte_bpe, rule_ledger, setsketch, wavelet

    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    shared = "one two three four"
    df = frame(spark, [(1, a), (2, b), (3, f"{a} {shared}"), (4, f"{b} {shared}"), (5, f"{a}\n{b}\n{a}")], extra=False)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in wavelet.wavelet_tokens(df, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = byte_bpe.encode_documents(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in pieces.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert all(r.component_id == r.doc_id for r in setsketch.near_duplicates(df).collect())
    assert {r.doc_id: r.n_dup_lines for r in rule_ledger.judge(df).collect()}[5] == 1


def test_fingerprints_tell_ranges_apart():
    from tidemark.llm.words import Hasher

    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 20_000).astype(np.uint8)
    start = rng.integers(0, 19_000, 30_000)
    end = start + rng.integers(0, 60, start.size)
    got, seen = Hasher(data, False).of(start, end), {}
    for s, e, h in zip(start.tolist(), end.tolist(), got.tolist()):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_gru_pools_what_its_positions_say():
    import pyarrow as pa

    from tidemark.llm import byte_gru
    from tidemark.llm.words import slices

    net = byte_gru.ByteGRU(["a", "b", "c"], hidden=5)
    rows = ["", "x", "é" * 64, "word " * 200, "y" * 128, "z" * 129, None, "\x00\xff and more"] * 3
    _, _, texts = next(slices(pa.array(rows)))
    got = net.pool(texts)
    for i, text in enumerate(rows):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        want = [net.positions(raw[at : at + 128, None], np.ones((raw[at : at + 128].size, 1), bool)) for at in range(0, raw.size, 128)]
        want = np.concatenate(want).mean(axis=(0, 1)) if want else np.zeros(3)
        assert np.allclose(got[i], want, atol=1e-5)
