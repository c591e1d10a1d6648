"""The queries against brute force, libraries and held-out rows, on the small tables."""
import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import corpus_pipeline as C
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as E
from mnemo.llm import langid, neardup, pages, pieces, secrets
from mnemo.llm.queries import piece_model
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="session")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return {r[0]: r for r in E.queries()[name](spark, SF).collect()}


def test_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_near_duplicates", "op8_near_vectors", "op10_dedup_lines"])
def test_oracles(spark, name):
    got = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF, duck(SF))
    assert got["ok"], got


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = rows(spark, "op2_identify_language")
    held = [i for i, r in got.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    right = sum(got[i].lang_pred == truth[i] for i in held if truth[i])
    assert right >= 0.95 * sum(truth[i] is not None for i in held)


def test_language_gradients():
    s = langid.Settings(hidden=3)
    net = langid.new_network(["a", "b", "c"], s)
    net = langid.Network(net.languages, *[[w.astype(np.float64) for w in x] for x in (net.byte, net.state, net.bias)],
                         net.out.astype(np.float64), net.base.astype(np.float64))
    rng = np.random.default_rng(0)
    data, valid, label = rng.integers(0, 256, (7, 4)), np.arange(7)[:, None] < np.array([7, 5, 3, 6]), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, data, valid, label)
    for w, g in zip(net.weights(), grads):
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            at = (at[0], int(data[0, 1])) if w.shape[1] == 256 else at
            old, ends = w[at], []
            for step in (1e-4, -1e-4):
                w[at] = old + step
                ends.append(langid.gradients(net, data, valid, label)[0])
            w[at] = old
            assert abs((ends[0] - ends[1]) / 2e-4 - g[at]) < 1e-4


def test_long_texts_are_labelled_as_in_one_go():
    s = langid.Settings(steps=20, hidden=4)
    net = langid.train([("abc def", "x"), ("uvw xyz", "y")] * 5, s)
    data = np.frombuffer(("abc def uvw xyz " * 60).encode(), np.uint8)
    one = langid.Labeller(net, langid.Settings(hidden=4, segment=len(data)))
    cut = langid.Labeller(net, langid.Settings(hidden=4, segment=50, run_in=30))
    ends = np.array([len(data)])
    assert np.allclose(one.pooled(data, ends * 0, ends), cut.pooled(data, ends * 0, ends), atol=2e-2)


def test_main_text(spark):
    table = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows(spark, "op3_extract_pages")
    from html import unescape
    for i, r in got.items():
        inner = re.search(r"<article>(.*?)(</article>|$)", table[i], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip()
                 for x in re.split(r"<(?:p|/p|h1|/h1)>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_other_page_layouts(spark):
    table = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    s = pages.Settings()
    net = pages.train([pages.cut_blocks(h) for h in table], s)
    body = ["A first paragraph with quite some words in it.", "Another one, which is longer than the first and goes on.", "End."]
    ps = "".join(f"<p>{b}</p>" for b in body)
    layouts = [
        f"<body><header><h2>Site</h2></header><main>{ps}</main><aside><p>Read this too, it is related.</p></aside></body>",
        f"<body><div id=menu><a>one</a></div><div class='post-content'>{ps}</div><div id=comments><p>Great text, I liked it.</p></div></body>",
        f"<body><div class='cookie-notice'>We use cookies.</div><article>{ps}<div class=ad>Buy now</div></article><form>Mail <input></form></body>",
    ]
    for html in layouts:
        blocks = pages.cut_blocks(html)
        chance = pages.article_chances(net, [blocks], s)[0]
        assert [b.text for b, c in zip(blocks, chance) if c > 0.5] == body


def test_blocks():
    got = pages.cut_blocks("<p title='a>b'>q<b>r</b>s<br>t</p><script>var x='<p>';</script>u &amp;&eacute;&#x41; <div>v</div><!-- c -->")
    assert [b.text for b in got] == ["qrs t", "u &éA", "v"]
    assert len(pages.cut_blocks("<div>x" * 20_000)) == 20_000


def test_verification_bound():
    for n in (36, 180):
        m = neardup.least_matches(n, 80, 1e-7)
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8 ** i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= 1e-7 > tail(m - 1)


def test_five_word_groups(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in sets}


def test_large_group_of_near_copies(spark):
    """One group that is a third of all rows, in small blocks."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(f"x{rng.random()}" if rng.random() < 0.01 else w for w in base)) for i in range(300)]
    docs += [(1000 + i, " ".join(f"y{rng.randrange(10 ** 6)}" for _ in range(50))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.Settings(width=2, block=32)).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in docs[:300]}
    root = list(range(300))
    for a, b in itertools.combinations(range(300), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)

    def find(i):
        return i if root[i] == i else find(root[i])
    assert all(got[i] == find(i) for i in range(300)) and all(got[i] == i for i in got if i >= 1000)


def test_family_that_is_alike_but_not_linked(spark):
    """A crowd of texts 65 to 80 % alike and some links among them: no join makes a row for
    each of its pairs, and the groups are those of all pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(f"x{rng.random()}" if rng.random() < 0.045 else w for w in base)) for i in range(400)]
    docs += [(500 + i, docs[rng.randrange(400)][1] + f" z{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    s = neardup.Settings(width=2, block=64)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, s).collect()}
    sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in docs}
    alike = [(a, b, 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in itertools.combinations(sets, 2)]
    assert sum(60 < x < 80 for *_, x in alike) > 50_000
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, x in alike:
        if x >= 80 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in sets}
    # what the blocks tell is a forest: fewer links than members, however many pairs there are
    members = df.withColumn("bucket", F.lit(1).cast("long")).withColumn("band", F.lit(0))
    sketches = neardup.sketch(df, s).withColumn("node", F.col("doc_id")).withColumn("bands", F.array_repeat(F.lit(7).cast("long"), s.bands))
    rows = members.join(sketches.select("doc_id", "node", "n_shingles"), "doc_id").withColumn("component", F.col("node"))
    wanted = sketches.select("node", "doc_id", "text_hash")
    links = neardup._links_in_buckets(rows.select("bucket", "band", "node", "n_shingles", "component"), sketches,
                                      neardup._full_sets(df, wanted, s, "text"), s).collect()
    blocks = -(-len(docs) // s.block)
    assert 0 < len(links) < len(docs) * blocks
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b]) for r in links)


def test_several_texts_under_one_id(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, one, "x"), (5, one, "y"), (5, two, "z"), (7, two, "z"), (5, two, "z"), (9, "solo text of five words", "s"),
                                (9, "", "e"), (9, "", "e")], "doc_id long, text string, more string")
    got = sorted(map(tuple, neardup.near_duplicates(df.select("doc_id", "text")).select("doc_id", "component_id", "kept").collect()))
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (9, 9, True), (9, 9, True)]
    kept = sorted(map(tuple, neardup.keep_one(df).collect()))
    assert kept == [(1, one, "x"), (5, two, "z"), (9, "", "e"), (9, "solo text of five words", "s")]


def test_fingerprint_likeness(spark, texts):
    got = rows(spark, "op5_fingerprint")
    order = sorted(texts)
    count = lambda t: collections.Counter(WORDS.findall(t))
    jaccard = lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values()))
    off = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, q = texts[a], len(texts[a]) // 4
        edited = t[:len(t) - q] + texts[b][:q]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == len(t)
        if WORDS.search(t) and WORDS.search(edited):
            off.append(got[a].near_edited - jaccard(count(t), count(edited)))
        assert 0 <= got[a].near_next <= 1
    assert abs(np.mean(off)) < 0.03 and np.sqrt(np.mean(np.square(off))) < 0.13


def test_secret_base(spark, texts):
    assign = re.compile(r"""(?:(?ai:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = rows(spark, "op6_scan_secrets")
    for i, t in texts.items():
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        told = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert set(told.split(",")) <= set(got[i].spans.split(","))


def test_secret_lexing():
    text = ("db_pw = 'hunter2hunter2'\nPASSWORD = db_pw\nK = \"Zx81kQmP\" + \"0aLw92hT\"\nclient.secret_token = K\n"
            "cfg = {\"auth-token\": \"f81d4fae7dec11d0a765\", 'name': \"bob builder\"}\npublic_key: abcd1234efgh5678\n"
            "password: changeme123\nos.environ[\"DB_PASSWORD\"] = \"s3cr3t-P4ss!\"\nNote: the token is here. key=val\n")
    got = [(n, text[a:b]) for _, a, b, n, _ in secrets.literal_spans(text)]
    assert got == [("PASSWORD", "hunter2hunter2"), ("client.secret_token", "Zx81kQmP"), ("client.secret_token", "0aLw92hT"),
                   ("auth-token", "f81d4fae7dec11d0a765"), ("DB_PASSWORD", "s3cr3t-P4ss!")]


@pytest.mark.parametrize("text,want", [
    ('const apiKey: string = "Zx81kQmP0aLw"', [("apiKey", "Zx81kQmP0aLw")]),
    ('private readonly api_key?: string = `Zx81kQmP0aLw`;', [("api_key", "Zx81kQmP0aLw")]),
    ('const cfg: Record<string, string> = {token: "Zx81kQmP0aLw", user: "robert12"}', [("token", "Zx81kQmP0aLw")]),
    ('<add key="dbPassword" value="hunter2X9kq"/>', [("dbPassword", "hunter2X9kq")]),
    ("<property name='secret.token' value='Zx81kQmP0aLw'></property>", [("secret.token", "Zx81kQmP0aLw")]),
    ("<password>hunter2X9kq</password>", [("password", "hunter2X9kq")]),
    ("password: |\n  hunter2X9kq\nnext: 1", [("password", "hunter2X9kq")]),
    ("- password: hunter2X9kq\n  auth_token:   Zx81kQmP0aLw  # note", [("password", "hunter2X9kq"), ("auth_token", "Zx81kQmP0aLw")]),
    ('password = """hunter2X9kq"""', [("password", "hunter2X9kq")]),
    ('private_key = """\n  Zx81kQmP0aLw\n  hunter2X9kq\n"""', [("private_key", "Zx81kQmP0aLw"), ("private_key", "hunter2X9kq")]),
    ('password = ("hunt" "er2X" "9kq1")', [("password", "hunt"), ("password", "er2X"), ("password", "9kq1")]),
    ('password = get_secret("prod/db/password")', []),
    ('secret_key = SecretStr("Zx81kQmP0aLw")', [("secret_key", "Zx81kQmP0aLw")]),
    ('f(password="hunter2X9kq", user="bob", token="Zx81kQmP0aLw")', [("password", "hunter2X9kq"), ("token", "Zx81kQmP0aLw")]),
    ('PWD, TOKEN = "hunter2X9kq", "Zx81kQmP0aLw"', [("PWD", "hunter2X9kq"), ("TOKEN", "Zx81kQmP0aLw")]),
    ("[db]\npassword = hunter2X9kq ; note\n", [("password", "hunter2X9kq")]),
    ("export DB_PASSWORD=hunter2X9kq", [("DB_PASSWORD", "hunter2X9kq")]),
    ('"apiKey" => "Zx81kQmP0aLw", token := "Zx81kQmP0aLx"', [("apiKey", "Zx81kQmP0aLw"), ("token", "Zx81kQmP0aLx")]),
    ("don't set password = hunter2X9kq isn't it", [("password", "hunter2X9kq")]),
    ('a = "Zx81kQmP"\nb = a\nclient_secret = b + "0aLw92"', [("client_secret", "Zx81kQmP"), ("client_secret", "0aLw92")]),
    ("time: 12:30:45 url: http://x.y/z", []), ("password: your_password_here", []), ("", []), ("=", []), ("a=\n=b\n:", [])])
def test_secret_syntaxes(text, want):
    assert [(n, text[a:b]) for _, a, b, n, _ in secrets.literal_spans(text)] == want


def test_secret_constants_do_not_grow():
    """Constants that double, and long chains of them: the work is that of the text."""
    import time
    began = time.time()
    text = 'a0 = "Zx81kQmP"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(200)) + "password = a200\n"
    assert [(n, text[a:b]) for _, a, b, n, _ in secrets.literal_spans(text)] == [("password", "Zx81kQmP")]
    text = 'a0 = "Zx81kQmP"\n' + "".join(f'a{i + 1} = a{i} + "k{i}Z"\n' for i in range(3000)) + "password = a3000\n"
    assert len(secrets.literal_spans(text)) == 3001
    for bit in ("a", "a=", '"', "'" * 3, '"' * 3, "a,", "a:b ", "f(a=", "<a b='", "x y ", "= ", "{a:", "a=(", "[a] = "):
        secrets.literal_spans(bit * (60_000 // len(bit)))
    assert time.time() - began < 30


@pytest.fixture(scope="session")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_pieces_like_the_library(spark, texts, library):
    got = rows(spark, "op7_encode_pieces")
    for i, t in texts.items():
        want = [*library.encode(t), 2]
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_pieces_on_odd_texts(library):
    model = pieces.load_model(piece_model())
    rng = random.Random(1)
    odd = ["", " ", "  ", "   a", "a ", "▁", "�", "a⁇b", "x" * 500, "ab" * 300, "漢字" * 40]
    odd += ["".join(rng.choice("ab  ▁\n\t\0é漢😀eth́‍<0x0A>") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t, (ids, ends) in zip(odd, model.encode_batch(odd)):
        assert ids == library.encode(t) and model.decode(ids) == library.decode(ids)
        raw, spans = t.encode(), [0, *ends]
        assert spans == sorted(spans) and spans[-1] == len(raw)
        whole = [i for i, x in enumerate(ids) if model.kinds[x] == pieces.NORMAL]
        for i in whole[1:]:
            assert raw[spans[i]:spans[i + 1]].decode() == model.pieces[ids[i]].replace("▁", " ") or "▁" in t
    for _ in range(1500):
        ids = [rng.choice([3 + rng.randint(0, 255), rng.randint(0, 31999), 0, 1, 2, 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def _field(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)


def _double_array(rules: dict[bytes, int]) -> list[int]:
    """A character map's trie: offset << 10 | leaf flag << 8 | label, and values at leaves."""
    units = {0: 0}
    free = itertools.count(1)

    def place(at, prefixes):
        labels = sorted({p[0] for p in prefixes if p})
        leaf = [v for p, v in prefixes.items() if not p]
        while True:
            base = next(free) << 8
            if not any(base ^ c in units for c in [*labels, 0]):
                break
        units[at] = units.get(at, 0) & 0x800000FF | (base ^ at) << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = 0x80000000 | leaf[0]
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            place(base ^ c, {p[1:]: v for p, v in prefixes.items() if p[:1] == bytes([c])})
    place(0, rules)
    return [units.get(i, 0) for i in range(-(-(max(units) + 257) // 256) * 256)]


def test_character_map_keeps_offsets():
    """A model with rules: the longest prefix is replaced and pieces keep the bytes they came from."""
    rules = {"ﬁ".encode(): "fi", "A".encode(): "a", "AB".encode(): "x", "\t".encode(): " "}
    strings, places = b"", {}
    for k, v in rules.items():
        places[k] = len(strings)
        strings += v.encode() + b"\0"
    trie = struct.pack(f"<{len(t := _double_array(places))}I", *t)
    chars = struct.pack("<I", len(trie)) + trie + strings
    names = [("<unk>", 0, 2), ("</s>", 0, 3), *[(p, -i, 1) for i, p in enumerate(["fi", "▁a", "▁fi", "▁", "a", "f", "i", "x", "n"])]]
    blob = b"".join(_field(1, 2, _field(1, 2, p.encode()) + _field(2, 5, struct.pack("<f", s)) + _field(3, 0, k)) for p, s, k in names)
    blob += _field(2, 2, _field(3, 0, 2)) + _field(3, 2, _field(2, 2, chars) + _field(4, 0, 1))
    model = pieces.PieceModel(blob)
    text = "  A\tﬁn  ABﬁ "
    ids, ends = model.encode(text)
    want = sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert ids == want.encode(text) and model.decode(ids) == want.decode(ids)
    raw = text.encode()
    spans = list(zip([0, *ends], ends))
    assert [raw[a:b].decode().strip() for a, b in spans][:2] == ["A", "ﬁ"] and [model.pieces[i] for i in ids][:2] == ["▁a", "▁fi"]


def test_kneser_ney(spark, texts):
    got = rows(spark, "op9_score_language_model")
    tokens = {i: [*WORDS.findall(t.translate(LOWER)), "</s>"] for i, t in texts.items()}
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    words, pairs = collections.Counter(), collections.Counter()
    for i in learnt:
        words.update(tokens[i])
        pairs.update(zip(["<s>", *tokens[i]], tokens[i]))
    total, distinct = sum(words.values()), len(words)
    second, begins = collections.Counter(w for _, w in pairs), collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), n in pairs.items():
        begins[v][min(n, 3) - 1] += 1

    def discounts(c):
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    d2, d1, kinds = discounts(pairs), discounts(second), sum(second.values())
    spare = sum(d1[min(n, 3) - 1] for n in second.values()) / kinds
    counts = {**words, "<s>": len(learnt)}

    def chance(w, v):
        p = spare / (distinct + 1) + ((second[w] - d1[min(second[w], 3) - 1]) / kinds if w in second else 0)
        if v in counts:
            n = pairs[v, w]
            p = p * sum(a * b for a, b in zip(d2, begins[v])) / counts[v] + ((n - d2[min(n, 3) - 1]) / counts[v] if n else 0)
        return p
    assert abs(sum(chance(w, "the") for w in words) + chance("no such word", "the") - 1) < 1e-9
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in words for w in t), total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.score - sum(math.log10(chance(w, v)) for v, w in zip(["<s>", *t], t))) < 1e-6
        assert abs(r.base_score - sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)) < 1e-6


def test_line_borders_resist_shifts(spark):
    from mnemo.llm.linededup import remove_repeated
    rng = random.Random(5)
    line = lambda: " ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(8))
    shared = [line() for _ in range(30)]
    docs = [(i, "\n".join([line() for _ in range(rng.randrange(1, 9))] + shared + [line() for _ in range(rng.randrange(1, 9))]))
            for i in range(12)] + [(100 + i, "\n".join(line() for _ in range(9))) for i in range(12)]
    got = {r.doc_id: r for r in remove_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 0 for i in range(100, 112))
    for i in range(1, 12):
        assert 20 <= got[i].n_removed <= 30
        own = [x for x in dict(docs)[i].split("\n") if x not in shared]
        assert [x for x in got[i].text.split("\n") if x not in shared] == own


def test_pipeline(spark, library):
    """Each stage against a brute-force version over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    from mnemo.llm.common import staged
    for name, stage in C.STAGES:
        made.append(staged(stage(spark, made[-1], SF), f"test_{name}"))
    raw, spoken, lines, kept, mixed, coded = ([r.asDict() for r in d.collect()] for d in made)
    # language: only texts that no language fits go
    gone = {r["doc_id"] for r in raw} - {r["doc_id"] for r in spoken}
    assert all(not re.search(r"[^\W\d_]", r["text"] or "") or len(r["text"]) < 40 for r in raw if r["doc_id"] in gone)
    assert all(r in raw for r in spoken)

    def chunks(text):
        ls = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
        r = [(x * 31 + (h[i - 1] if i else 0) * 17) % 2147483647 for i, x in enumerate(h)]
        out = [[]]
        for i, x in enumerate(ls):
            out[-1].append(x)
            if 0 < i < len(ls) - 1 and r[i] < r[i - 1] and r[i] <= r[i + 1]:
                out.append([])
        return out
    seen, want = set(), {}
    for r in sorted(spoken, key=lambda r: r["doc_id"]):
        left = []
        for c in chunks(r["text"]):
            body = "\n".join(c)
            if len(c) >= 2 and len(WORDS.findall(body)) >= 10:
                if body in seen:
                    continue
                seen.add(body)
            left += c
        want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    sets = {}
    for i, t in want.items():
        w = WORDS.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i in sets if find(i) == i)
    times = collections.Counter(r["doc_id"] for r in mixed)
    assert set(times.values()) <= {1, 2} and set(times) <= {r["doc_id"] for r in kept}
    by = {s: sorted(x for x in {r["source"] for r in kept}).index(s) for s in {r["source"] for r in kept}}
    size = {r["doc_id"]: len(WORDS.findall(r["text"])) for r in kept}
    own = collections.Counter()
    took = collections.Counter()
    for r in kept:
        own[r["source"]] += size[r["doc_id"]]
        took[r["source"]] += size[r["doc_id"]] * times[r["doc_id"]]
    level = {s: (5, 2, 1)[by[s] % 3] for s in own}
    closed: set = set()
    while True:
        open_ = [s for s in own if s not in closed]
        rate = (1.5 * sum(own.values()) - 2 * sum(own[s] for s in closed)) / sum(level[s] for s in open_)
        more = {s for s in open_ if level[s] * rate > 2 * own[s]}
        if not more:
            break
        closed |= more
    largest = {s: max(size[r["doc_id"]] for r in kept if r["source"] == s) for s in own}
    for s in own:
        assert abs(took[s] - (2 * own[s] if s in closed else level[s] * rate)) <= largest[s] + 1
    text_of = {r["doc_id"]: r["text"] for r in kept}
    assert len(coded) == len(mixed)
    for r in coded:
        assert list(r["ids"]) == [*library.encode(text_of[r["doc_id"]]), 2] and r["n_tokens"] == len(r["ids"])
