"""Whole articles and links in linear time, short items, entity groups, trust, penalties."""

import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import fm_toxicity, link_trust, pii_sanitise, spaced_seeds, tree_extract

P = "<p>" + "some words, and more of them here " * 5 + ".</p>"
TEXT = ("some words, and more of them here " * 5 + ".").replace("  ", " ")


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<h2 id='sharing-data'>Sharing</h2>", ["Sharing"]),
        (f"<section id='related-work'><h2 class='related'>Before</h2>{P}</section>", ["Before", TEXT]),
        ("<div class='social-history'>Short.</div><div class='info-notice'>As well.</div>", ["Short.", "As well."]),
        (f"<section id='login'>{P}</section>", [TEXT]),
        ("<p>x <math><mi>y</mi></math> z</p>", ["x y z"]),
        (f"<div class='cookie-notice'>{P}</div><div class='share-buttons'>Share</div><aside>{P}</aside>", []),
        (f"<div class='related-posts-today'><a href=x>one</a> <a href=y>two</a></div><form>{P[:20]}<button>b</button></form>", []),
    ],
)
def test_marks_cut_only_boilerplate(inside, want):
    comments = f"<section id=comments><article class=comment>{P * 9}</article></section>"
    page = f"<body><nav><a href=/>n</a></nav><article>{P}{inside}{P * 2}</article>{comments}</body>"
    assert tree_extract.main_text(page).split("\n\n") == [TEXT, *want, TEXT, TEXT]


def test_wrappers_and_siblings_are_read():
    assert tree_extract.main_text(f"<body><div class='banner'>{P * 2}</div><div class=menu><a>m</a></div>").count(TEXT) == 2
    assert tree_extract.main_text(f"<body><form action=x>{P * 3}<select><option>o</select></form>").count(TEXT) == 3
    page = f"<body><div><section>{P * 4}</section><section>{P * 2}</section><ul><li>one<li>two</ul><div><a>l</a></div></div>"
    assert tree_extract.main_text(page).split("\n\n") == [TEXT] * 6 + ["one", "two"]


def test_pages_equal_a_plain_reading(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|h3|ul|li|blockquote)>", re.sub(r"<br\s*/?>", " ", body))
        plain = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
        assert tree_extract.main_text(r.html) == "\n\n".join(b for b in plain if b)


@pytest.mark.parametrize(
    "page",
    [
        "<p>" + "x < y <b" * 120_000, "<div>text " * 100_000, "<a href='" * 110_000, "<a '='" * 160_000, "<!--" * 250_000,
        "<p>" + "<span>" * 80_000 + "<h1>a</h1>b" * 40_000, "<table><p>" + "<span>" * 80_000 + "<li>a" * 80_000,
        "<p><b>x</i>" * 90_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    started = time.process_time()
    tree_extract.main_text(page)
    assert time.process_time() - started < 12  # a quadratic reading takes hours


# 10


def brute_terms(texts):
    """{text: {(word start, level)}} by the estimate as the module states it, over Python dicts."""
    from math import log2

    reach, prior = pii_sanitise.REACH, pii_sanitise.PRIOR
    pairs, words_of = {}, {}
    for text in set(texts):
        spans, found, at = pii_sanitise.base_spans(text), [], 0
        for m in re.finditer(r"[^\x20\x09-\x0d]+", text):
            end = m.end()
            while end > m.start() and text[end - 1].isascii() and not text[end - 1].isalnum() and text[end - 1].isprintable():
                end -= 1
            if end > m.start():
                word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[m.start() : end])
                found.append((m.start(), end, word))
        words_of[text] = {w for _, _, w in found}
        near = pairs[text] = set()
        for kind, a, b in spans:
            lo = sum(e <= a for _, e, _ in found)
            hi = sum(s < b for s, _, _ in found)
            for i in range(max(lo - reach, 0), min(max(lo, hi) + reach, len(found))):
                s, e, w = found[i]
                if "\n" in text[min(s, a) : max(e, b)] or any(s < y and x < e for _, x, y in spans):
                    continue
                plain = kind, pii_sanitise._plain(kind, text[a:b])
                near.add((plain, (kind, pii_sanitise.group_of(kind, text[a:b])), w))
    n_e, n_g, n_et, n_gt, n_t, kinds = Counter(), Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for text in pairs:
        spans = pii_sanitise.base_spans(text)
        both = {((k, pii_sanitise._plain(k, text[a:b])), (k, pii_sanitise.group_of(k, text[a:b]))) for k, a, b in spans}
        n_e.update({e for e, _ in both})
        n_g.update({g for _, g in both})
        for e, g in both:
            kinds[g].add(e)
        n_et.update({(e, w) for e, _, w in pairs[text]})
        n_gt.update({(g, w) for _, g, w in pairs[text]})
        n_t.update(words_of[text])
    out = {}
    for text, near in pairs.items():
        levels = out[text] = {}
        for e, g, w in near:
            ne, et, ng, gt = n_e[e], n_et[e, w], n_g[g], n_gt[g, w]
            rate = (n_t[w] - 1) / max(len(pairs) - 1, 1)
            if len(kinds[g]) < 2 or gt < 2:
                ng, gt = ne, et
            if not rate or max(et, gt) < 2:
                continue
            less, out_of = (et, ne) if et > 1 else (1, 1)
            rest = (max(gt - less, 0) + prior * rate) / (max(ng - out_of, 0) + prior)
            given = (et - 1 + prior * rest) / (ne - 1 + prior)
            held = log2(len(pairs) / ne)
            share = log2(given / rate) / held if held > 0 else 0
            level = 2 if share >= pii_sanitise.REMOVE_FROM else 1 if share >= pii_sanitise.GENERALISE_FROM else 0
            if level:
                levels[w] = max(level, levels.get(w, 0))
    return out


def group_texts():
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{fill(20)}\n{fill(9)} Quarnish {fill(4)} user{i}@quarnish.example, {fill(9)}\nOther {fill(9)}" for i in range(5)]
    texts += [f"{fill(9)} host-{i % 3} 10.77.{i}.{i % 4} {fill(5)} +1 (771) 555-0{100 + i % 5}" for i in range(14)]
    texts += [f"{fill(30)} {fill(300)} boss@solo.example {fill(280)} Farword" for _ in range(3)]
    texts += [fill(30) for _ in range(150)] + ["a@b.example " * 5, "", "1@x.org"] + [texts[0]] * 4
    return texts


@pytest.mark.parametrize("at_once", [1 << 11, 1])
def test_estimate_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(pii_sanitise, "AT_ONCE", at_once)
    texts = group_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    told = {r._id: {t.term: t.level for t in r._terms} for r in pii_sanitise._revealing(df).collect()}
    want = brute_terms(texts)
    name = lambda w: int(pii_sanitise._places(w, w.encode())[0][0])
    for i, t in enumerate(texts):
        assert told.get(i, {}) == {name(w): level for w, level in want[t].items()}
    assert all(name("quarnish") in told[i] for i in range(5))  # each address stands in one text only
    clean = {r.doc_id: r.text for r in pii_sanitise.sanitise(df).collect()}
    assert len(clean) == len(texts) and not any("Quarnish" in clean[i] for i in range(5)) and "Farword" in clean[19]


def test_groups_of_entities():
    of = pii_sanitise.group_of
    assert of("email", "A.b@Mail.Example.com") == "mail.example.com" and of("ip", "10.2.33.4") == "10.2"
    assert of("card", "4111 1111 1111 1111") == "411111"
    assert of("phone", "+1 (771) 555-1655") == "1771" and of("phone", "+17715551655") == "1771"


def test_directory_of_addresses_takes_linear_time():
    text = " ".join(f"Name{i} n{i}@dir.example" for i in range(40_000))
    started = time.process_time()
    spans = pii_sanitise.base_spans(text)
    pairs = sum(e.size for e, _, _ in pii_sanitise._evidence(text, text.encode(), spans))
    assert len(spans) == 40_000 and pairs > 40_000 * 200 and time.process_time() - started < 30


def test_empty_documents_are_sanitised(spark):
    df = spark.createDataFrame([], "doc_id int, text string, n_chars int, _key int, _terms int")
    out = pii_sanitise.sanitise(df)
    assert out.columns == df.columns and out.count() == 0
    odd = spark.createDataFrame([(None, None, 1, 2, 3), (1, "", 0, 2, 3), (1, "x a@b.cc", 8, 2, 3)], df.schema)
    assert sorted((r.text or "-") for r in pii_sanitise.sanitise(odd).collect()) == ["-", "-", "x [EMAIL]"]


# 3


def test_any_one_substitution_leaves_the_item_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in range(9, 17)}
    rows = []
    for n, words in items.items():
        for p in range(n):
            changed = words[:p] + [word()] + words[p + 1 :]
            rows.append((100 * n + p, " ".join([*(word() for _ in range(20)), *changed, *(word() for _ in range(20))])))
    rows += [(i, " ".join(word() for _ in range(60))) for i in range(20)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id int, text string")
    found = spaced_seeds.contaminated(spark.createDataFrame(rows, "doc_id int, text string"), bench).collect()
    got = {r.doc_id: (r.item_id, r.matched, r.aligned) for r in found}
    assert set(got) == {i for i, _ in rows if i >= 100}
    assert all(v == (i // 100, i // 100 - 1, i // 100) for i, v in got.items())


# 4


def test_links_are_read_once_and_data_attributes_are_none(spark):
    page = (
        "<a data-href='//no.net/'>x</a><a\nclass=b HREF = //Yes.net/p>y</a><abbr href='//no.org/'>"
        "<a title='href' href=\"http://two.net\">z</a><a href='//cut.net'<b>"
    )
    hostile = ["<a " * 100_000, "<a" + " " * 100_000 + ">", "<a " + "href " * 60_000, "<a href=" + " " * 200_000 + ">", "<a href='" * 60_000]
    pages = spark.createDataFrame([(0, "http://me.org/", page), *((i, "http://x.org/", h) for i, h in enumerate(hostile, 1))], "page_id int, url string, html string")
    start = time.time()
    got = {(r.src, r.dst) for r in link_trust.host_edges(pages).collect()}
    assert got == {("me.org", "yes.net"), ("me.org", "two.net"), ("me.org", "cut.net")}
    assert time.time() - start < 20


def test_large_sites_weigh_no_more_than_small_ones_and_ties_are_allowed(spark):
    pages = [(i, f"http://big.com/fr/{i}", None) for i in range(300)] + [(1000 + i, f"http://bad.com/de/{i}", "<a href='//big.com/'>") for i in range(3)]
    # next.com links to a blocked host and is linked by an allowed one with hundreds of pages
    pages += [(2000, "http://next.com/en", "<a href='//bad.com/'>"), (3000, "http://even.com/fr/", None), (3001, "http://even.com/de/", None), (3002, "http://even.com/en/", None)]
    rules = [("allow", "com/fr/"), ("block", "com/de/")]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r for r in link_trust.filter_pages(df, rules).collect()}
    assert got[2000].verdict == "block" and got[3002].verdict == "allow"
    assert sum({r.host: r.trust for r in got.values()}.values()) == pytest.approx(1.5, rel=1e-3)


def test_trust_through_a_hub_of_many_hosts(spark):
    n = 20_000
    hosts = spark.range(n).selectExpr("concat('h', id, '.net') AS src", "'hub.net' AS dst")
    edges = hosts.unionByName(hosts.selectExpr("dst AS src", "src AS dst"))
    edges = edges.selectExpr("src", "dst", f"IF(src = 'hub.net', 1D / {n}, 1D) AS share", f"IF(dst = 'hub.net', 1D / {n}, 1D) AS back")
    seeds = spark.createDataFrame([("h0.net", 1.0, 0.0), ("h1.net", 0.0, 1.0)], "host string, allowed double, blocked double")
    got = link_trust.conserve(link_trust.propagate(seeds, edges), seeds)
    hub, leaf = 0.85 * 0.15 / (1 - 0.85**2), 0.85**2 * 0.15 / (1 - 0.85**2) / n
    rows = {r.host: r for r in got.filter("host IN ('hub.net', 'h0.net', 'h7.net')").collect()}
    assert got.count() == n + 1
    assert rows["hub.net"].trust == pytest.approx(hub, rel=1e-2) and rows["h7.net"].trust == pytest.approx(leaf, rel=1e-2)
    assert rows["h0.net"].trust == pytest.approx(0.15 + leaf, rel=1e-2)


# 7


def test_penalties_come_from_folds_and_terms_are_counted(spark):
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(240):
        toxic = i % 3 == 0
        rows.append(np.unique(np.append(rng.integers(100, 400, 30), 7 if toxic else 8)))
        y.append(float(toxic))
    grid = (fm_toxicity.Penalties(500.0, 20.0, 2.4), fm_toxicity.PENALTIES)
    dull, keen = fm_toxicity.fold_losses(rows, np.array(y), grid)
    assert keen < dull
    model = fm_toxicity.fit_chosen(rows, np.array(y), grid)
    assert 7 in model.places
    # terms of fewer documents never leave Spark; the empty text keeps its row
    text = [(i, f"common{i % 2} rare{i}x" if i else None, "lang", 3) for i in range(60)]
    docs = spark.createDataFrame(text, "doc_id bigint, text string, toxic string, count int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    found, marks = fm_toxicity.labelled_terms(docs, labels)
    learn = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    assert len(found) == len(learn) and marks.tolist() == [i % 2 for i in learn]
    # common0 or common1, and beginnings of it and of rare<i>x, in five documents or more
    assert max(map(len, found)) <= 7 and [len(f) == 0 for f in found] == [i == 0 for i in learn]
    assert len(fm_toxicity.labelled_terms(docs.limit(0), labels)[0]) == 0
