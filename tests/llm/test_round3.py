"""Alignment, filter audit and personal data against brute force, and on odd rows."""
import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from messy_rows import LONG, messy, nothing  # noqa: F401
from mnemo.llm import alignment, audit, personal
from mnemo.llm.queries import both_tokenizers

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ alignment

@pytest.fixture(scope="module")
def both():
    return both_tokenizers()


def plain_groups(t, text):
    """Groups of a text, tokenised whole by the libraries; None where it has no tokens."""
    data = (" " + (text or "")).encode()
    a, b = t.a.encode(" " + (text or ""), add_special_tokens=False).ids, t.b.encode(text or "")
    if not text or b"".join(t.a_bytes[i] for i in a) != data or b"".join(t.b_bytes[i] for i in b) != data:
        return None
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        group = ([], [])
        while not group[0] or x != y:
            if x <= y:
                group[0].append(a[i])
                x += len(t.a_bytes[a[i]])
                i += 1
            else:
                group[1].append(b[j])
                y += len(t.b_bytes[b[j]])
                j += 1
        out.append(group)
    return out


def plain_links(t, group):
    """Pairs of tokens of a group whose bytes overlap, each pair of occurrences once."""
    def spans(ids, table):
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        return list(zip(ids, [0, *ends], ends))
    return [(a, b) for a, s, e in spans(group[0], t.a_bytes) for b, u, v in spans(group[1], t.b_bytes) if max(s, u) < min(e, v)]


def plain_digests(t, texts):
    """The rows of the query for texts, by the contract's words."""
    found = [plain_groups(t, x) for x in texts]
    linked = [[p for g in f or [] for p in plain_links(t, g)] for f in found]
    n = Counter(p for x in linked for p in x)
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    out = []
    for f, x in zip(found, linked):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f)
        out.append((sum(len(a) for a, _ in f), sum(len(b) for _, b in f), len(f), len(x), sum(n[p] == best[p[1]] for p in x),
                    sum(n[p] for p in x), hashlib.sha256(told.encode()).hexdigest()))
    return out


BITS = ["the", "Ünï", "日本語", "a", "  ", " ", "\n", "\t", "foo.bar", "'s", "don't", "123456", "<|endoftext|>", "😀é", " ", "　",
        "x" * 30, "(){}", "\x1c", " ", "ﬁ", "\x00", "É", "word"]


def odd_texts(seed, count, marks=0.03):
    r = random.Random(seed)
    return ["".join(r.choice([*BITS, "▁"] if r.random() < marks else BITS) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(14)))
            for _ in range(count)]


def test_segments_are_tokenised_as_in_their_text(both):
    for i, text in enumerate(odd_texts(1, 2000)):
        if i % 400 == 0:
            both.forget()
        at, n = both.rows([text])
        want = plain_groups(both, text)
        assert bool(n[0]) == (want is not None)
        if want:
            told = ";".join(both.strings()[i] for i in at)
            assert told == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert sorted(both.links.gather(at)[0].tolist()) == sorted(a << 32 | b for g in want for a, b in plain_links(both, g))


def test_composition_is_associative(both):
    """Ranges of any size, folded in any grouping, give the groups of the whole text."""
    r = random.Random(2)
    for text in odd_texts(3, 800, 0):
        want = plain_groups(both, text)
        if want is None:
            continue
        data = (" " + text).encode()
        for chunk in (1, 5, 17, 60):
            parts, last = [], 0
            for start, stop, low, high in alignment.ranges(data, chunk):
                assert start == last and low <= start < stop <= high
                last = stop
                at = np.array(both.segments([data[low:high].decode()[1:]])[0])
                a, b = both.a_ids.gather(at)[0], both.b_ids.gather(at)[0]
                parts.append(alignment.fragment(a, b, low + np.cumsum(both.a_sizes[a]), low + np.cumsum(both.b_sizes[b]), start, stop))
            assert last == len(data)
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                j = i + r.randrange(2, 4)
                parts[i:j] = [alignment.compose(parts[i:j])]
            a, b, a_sizes, b_sizes = alignment.groups(parts[0])
            assert a.tolist() == [x for g in want for x in g[0]] and b.tolist() == [x for g in want for x in g[1]]
            assert a_sizes.tolist() == [len(g[0]) for g in want] and b_sizes.tolist() == [len(g[1]) for g in want]


def test_long_text_without_borders(both):
    data = b" " + b"x" * 5000 + b" end"
    assert len(list(alignment.ranges(data, 100))) <= 3


@pytest.mark.parametrize("chunk,at_once", [(1 << 16, 1 << 20), (40, 300)])
def test_alignment_of_all_documents(spark, both, chunk, at_once):
    """Short and long path, one pass over the counts and several: as by brute force."""
    texts = [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where length(text) < 3000 order by doc_id").fetchall()][:60]
    texts += odd_texts(5, 60) + [None, "", " ", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    whole = alignment.Alignment(docs, both, chunk=chunk)
    got = whole.digests(whole.pair_counts(), at_once)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[1:] for r in rows] == plain_digests(both, texts)
    out = {r.doc_id: r for r in whole.aligned().collect()}
    for i, t in enumerate(texts):
        want = plain_groups(both, t) or []
        assert out[i].text == t and out[i].a_ids == [x for g in want for x in g[0]] and out[i].b_sizes == [len(g[1]) for g in want]


def test_alignment_of_odd_rows(messy, nothing, both):
    out = alignment.align(messy, both, chunk=10_000)
    assert out.columns == [*messy.columns, *alignment.PARTS]
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in messy.collect())
    for r in rows:
        want = plain_groups(both, r.text) if r.text and len(r.text) < 1000 else None
        if want is not None:
            assert r.a_ids == [x for g in want for x in g[0]]
        if not r.text:
            assert r.a_ids == r.b_ids == r.a_sizes == r.b_sizes == []
        if r.doc_id == 5:
            assert "".join(both.a_bytes[i].decode() for i in r.a_ids) == " " + LONG and sum(r.b_sizes) == len(r.b_ids)
    assert alignment.align(nothing, both).count() == 0
    none = alignment.Alignment(nothing, both)
    assert none.digests(none.pair_counts()).count() == 0


# ------------------------------------------------------------------ filter audit

def plain_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * (i is not None and i > least[t])
        fails.append((lang or "", f, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        for order in map("".join, permutations("ABCDE")):
            for s, own in enumerate(order):
                n = Counter()
                for p, f, g, x in fails:
                    if p == part:
                        before = set(order[:s]) & set(f)
                        here = own in f and not before
                        n.update({"kept": own not in f and not before, "removed": here, "redundant": own in f and bool(before),
                                  "unique": f == own, "good": here and g, "toxic": here and x})
                shapley[part, own] += n["removed"]
                out[part, order, s + 1] = [n[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def counters(spark, tmp_path, rows, labels, files, **more):
    """The audit of rows dealt over files, one micro-batch each."""
    path = str(tmp_path / f"docs-{files}.parquet")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits string")
    for k in range(files):
        df.where(F.pmod(F.hash("doc_id", "text", "lang"), F.lit(files)) == k).coalesce(1).write.mode("append").parquet(path)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = audit.count_masks(spark, path, "doc_id long, text string, lang string", marks, **more)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(counts).collect()}


def test_audit_retracts_across_batches(spark, tmp_path):
    """Copies under falling ids in several files: every batch takes back what it must."""
    r = random.Random(4)
    texts = ["a b c", "CAPS and # marks", " ".join(f"w{i}" for i in range(250)), "same " * 300, "", None, "x | y", "Ü É é"]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "de", None, ""]), "x") for _ in range(150)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2) for _ in range(r.choice([1, 2]))] + [(None, 1, 1)]
    want = plain_audit([x[:3] for x in rows], labels)
    assert counters(spark, tmp_path, rows, labels, 4, batch_bytes=1, texts=20) == want
    assert counters(spark, tmp_path, rows, labels, 1) == want
    assert len(want) == 3 * 600


def test_retraction_alone():
    """State and counter changes add up to the same however the rows of the texts arrive."""
    r = random.Random(5)
    for _ in range(300):
        rows = [(r.randrange(3), r.randrange(6), r.choice("pq"), r.choice([0, 3])) for _ in range(r.randrange(1, 14))]
        least = {}
        for t, i, *_ in rows:
            least[t] = min(i, least.get(t, i))
        want = Counter((p, m | (audit.REPEATED if i > least[t] else 0)) for t, i, p, m in rows)
        total, known, at = Counter(), {}, 0
        while at < len(rows):
            step = r.randrange(1, 5)
            for k, n in audit.retract(known, [(t, -t, i, p, m, 1, 1) for t, i, p, m in rows[at:at + step]]).items():
                total[k] += n
            known = audit._unpacked(audit._packed(known))
            at += step
        assert {k: n for k, n in total.items() if n} == want
        assert {h: i for (h, _), (i, _) in known.items()} == least


def test_audit_of_odd_tables(spark, tmp_path, messy, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, df in (("messy", messy), ("nothing", nothing)):
        path = str(tmp_path / f"{name}.parquet")
        df.write.parquet(path)
        counts = audit.count_masks(spark, path, "doc_id long, text string, lang string", marks)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(counts).collect()}
        assert got == plain_audit([(r.doc_id, r.text, r.lang) for r in df.collect()], [])


# ------------------------------------------------------------------ personal data

# the contract's patterns
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_pattern(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                double = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("letters", ["a.@-1 ", "0123456789 -.+", "1 .+()-5", "ab@.é1%", "1.25", "+1( 2)x", "@.a", "0 4-", "٣1.+@ 4"])
def test_base_kinds_equal_their_patterns(letters):
    r, automaton = random.Random(letters), personal.anchors()
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randrange(70)))
        assert [s for s in personal.spans(text, automaton) if s[0] in personal.BASE] == by_pattern(text), text


@pytest.mark.parametrize("text,kind,value", [
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", "account", "DE89 3704 0044 0532 0130 00"), ("iban DE89370400440532013000.", "account", "DE89370400440532013000"),
    ("my SSN is 123-45-6789.", "account", "123-45-6789"), ("Passport no. X1234567 and", "account", "X1234567"),
    ("account number: 12345678", "account", "12345678"), ("Kontonummer 1234567890", "account", "1234567890"),
    ("write mailto:j.o'neil@host now", "url", "mailto:j.o'neil@host"), ("https://bob:pw@example.org:80/x", "url", "https://bob:pw@example.org:80"),
    ("call tel:+1-201-555-0123;", "url", "tel:+1-201-555-0123"), ("SIP:anna@voice.example.", "url", "SIP:anna@voice.example")])
def test_added_kinds(text, kind, value):
    found = personal.spans(text, personal.anchors())
    assert (kind, value) in [(k, text[a:b]) for k, a, b in found]
    assert value not in personal.masked(text, found)


@pytest.mark.parametrize("text", ["IBAN DE89 3704 0044 0532 0130 01", "SSN 000-12-3456", "accounting 123456789", "account of the year 2024", "http://example.com/a",
                                  "a tel: word", "mailto: nobody", "passport control at noon", "the compte rendu", "myiban 12"])
def test_clean_texts_are_left_alone(text):
    assert personal.spans(text, personal.anchors()) == []


def test_work_follows_the_length():
    """Texts that make careless patterns quadratic."""
    import time
    automaton, began = personal.anchors(), time.time()
    for bit in ("a", "1", "1.", "1 ", "+1(", "a@", "a@b", "@", "mailto:", "http://a:", "account no ", "iban a1 ", "1-", "+"):
        personal.spans(bit * (200_000 // len(bit)), automaton)
    assert time.time() - began < 20


def test_personal_odd_rows(spark, messy, nothing):
    got = personal.find_personal(messy)
    assert got.count() == messy.count() and got.columns == [c for c in messy.columns if c != "found"] + ["found", "masked"]
    assert all(r.masked == (r.text or "") and r.found == [] for r in got.collect())
    assert personal.digest(personal.find_personal(nothing)).count() == 0
    text = "é mail a.b@c.de or 1.2.3.4"
    r = personal.digest(personal.find_personal(spark.createDataFrame([(1, text)] * 2, "doc_id long, text string"))).collect()
    assert r[0] == r[1] and (r[0].n_email, r[0].n_ip, r[0].spans) == (1, 1, "email:7:15,ip:19:26")
    assert r[0].base_sha256 == hashlib.sha256(r[0].spans.encode()).hexdigest()


# ------------------------------------------------------------------ pages of unusual layouts

PARAGRAPHS = ["The river rose in the night and by morning the lower town was cut off.",
              "Farmers moved their cattle to the ridge, and boats were brought from the harbour.",
              "Nobody had seen such a flood for forty years, the mayor said on Sunday.",
              "Volunteers filled sandbags until dawn and served soup in the school hall.",
              "By noon the water had begun to fall, and the first families went home.",
              "Repairs to the bridge will take until spring, engineers expect."]
PS = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
NAV = "<nav><ul><li><a href=#>Home</a></li><li><a href=#>News</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 by us. All rights reserved.</p></footer>"
SIDE = '<div class="sidebar"><h3>Popular</h3><ul><li><a href=#>Ten tips</a></li><li><a href=#>Our shop</a></li></ul></div>'
SAID = '<div class="comments"><h3>Comments</h3><div class="comment"><p>Great piece, thanks for it!</p></div></div>'
ROWS = "".join(f"<tr><td>Gauge {i}</td><td>{i * 3} metres</td></tr>" for i in range(10))
LAYOUTS = [
    f"<html><body><form>{NAV}<div id=content>{PS}</div>{FOOT}</form></body></html>",
    f"<html><body><form>{NAV}<article>{PS}</article>{FOOT}</form></body></html>",
    f'<html><body class="has-sidebar no-footer">{NAV}<article>{PS}</article>{SIDE}{FOOT}</body></html>',
    f'<html><body class="page has-sidebar no-footer">{NAV}<div class="post">{PS}</div>{SIDE}{FOOT}</body></html>',
    f"<html><body><table><tr><td>{NAV}</td></tr><tr><td>{PS}</td></tr><tr><td>{FOOT}</td></tr></table></body></html>",
    f"<html><body><table><tbody><tr><td class=menu><a href=#>Home</a></td><td>{PS}</td></tr></tbody></table></body></html>",
    f'<html><body>{NAV}<article class="post read-more related-topic">{PS}</article>{FOOT}</body></html>',
    f"<html><body>{NAV}<article>{PS}<table>{ROWS}</table></article>{FOOT}</body></html>",
    f'<html><body>{NAV}<div class="search-results"><div class="entry-content">{PS}</div></div>{FOOT}</body></html>',
    f"<html><body>{PS}</body></html>", f"<html><body><div>{PS}</div></body></html>",
    f"<html><body><header><h1>Site</h1>{NAV}</header><main>{PS}</main>{SIDE}{FOOT}</body></html>",
    f'<html><body>{NAV}<section class="story">{PS}</section>{SAID}{FOOT}</body></html>',
    f'<html><body class="single logged-in"><div id="page" class="site"><header class="site-header">{NAV}</header><div class="site-content">'
    f'<div class="entry-content">{PS}</div></div>{SAID}{SIDE}{FOOT}</div></body></html>',
    '<html><body><div id=wrapper><div class=nav><a href=#>Home</a></div><div class="text">' + "".join(f"<div>{x}</div>" for x in PARAGRAPHS)
    + "</div><div class=footer>Copyright us</div></div></body></html>",
    f"<html><body>{NAV}<article><h1>The flood</h1>{PS}<blockquote><p>We were lucky this time, said one farmer.</p></blockquote></article>{FOOT}</body></html>",
    f"<html><body>{NAV}<article><p>{PARAGRAPHS[0]}</p><div class=newsletter><p>Sign up for our letter.</p><form><input></form></div>{PS}</article>{FOOT}</body></html>",
    f'<html><body><div class="cookie-notice"><p>We use cookies on this site.</p></div><div class="content">{PS}</div>{FOOT}</body></html>',
    f'<html><body class="sidebar-right"><div class="main-content">{PS}</div><aside class="sidebar"><p>About the author of this site.</p></aside></body></html>',
    f'<html><body><div id="header"><a href=#>Home</a></div><div id="article-body">{PS}</div><div id="footer">Contact us</div></body></html>',
    f"<html><body>{NAV}<main><h2>What happened</h2><ul>" + "".join(f"<li>{x}</li>" for x in PARAGRAPHS) + f"</ul></main>{FOOT}</body></html>",
    f"<html><body>{NAV}<article><dl>" + "".join(f"<dt>Day {i}</dt><dd>{x}</dd>" for i, x in enumerate(PARAGRAPHS)) + f"</dl></article>{FOOT}</body></html>"]
NEVER = ["Home", "News", "Copyright 2024 by us. All rights reserved.", "Popular", "Ten tips", "Our shop", "Comments", "Great piece, thanks for it!",
         "Site", "Copyright us", "We use cookies on this site.", "About the author of this site.", "Contact us", "Sign up for our letter."]


def test_names_that_tell_nothing_of_a_block():
    from mnemo.llm import pages
    told = lambda html: [pages.taught(b) for b in pages.marked(pages.cut_blocks(html))]
    assert told("<body class='has-sidebar'><article class=related><p>a</p><p>b</p></article>") == [True, True]
    assert told("<form><article><p>a</p><aside>c</aside><p>b</p></article></form>") == [True, False, True]
    assert told("<div class=comments><article><p>a</p></article></div><article><p>" + "long text " * 40) == [False, True]
    assert told("<div class=search><div class=search>x</div><article><p>" + "long text " * 40 + "</p></article></div>") == [False, True]


def test_unseen_layouts():
    """Pages of layouts that training has not: nearly every paragraph of the article, and
    nothing of the rest."""
    from mnemo.llm import pages
    sample = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    net = pages.train([pages.cut_blocks(x) for x in sorted(sample)])
    found = lost = wrong = 0
    for html in LAYOUTS:
        blocks = pages.cut_blocks(html)
        got = [b.text for b, c in zip(blocks, pages.article_chances(net, [blocks], pages.Settings())[0]) if c > 0.5]
        found += sum(p in got for p in PARAGRAPHS)
        lost += sum(p not in got for p in PARAGRAPHS)
        wrong += sum(x in got for x in NEVER)
    assert lost <= 0.05 * (found + lost) and wrong <= 1
