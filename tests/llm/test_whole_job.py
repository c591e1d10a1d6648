"""Jobs that were once cut short."""
import numpy as np

from mnemo.llm import fingerprint, langid, pages


def test_unclosed_elements_hide_nothing():
    cut = lambda html: [b.text for b in pages.cut_blocks(html)]
    page = "<html><head><meta charset=x><title>T</title><script>s</script>{}<article><p>one</p><p>two</p></article></html>"
    for gap in ("</head><body>", "<body>", "", "<body class=x>", "</head>"):
        assert cut(page.format(gap)) == ["one", "two"], gap
    assert cut("<head><title>T</title>text <b>bold</b><p>one") == ["text bold", "one"]
    assert cut("<head><title>T</title><a href=x>link</a><p>one") == ["link", "one"]
    for tag in ("button", "select", "select><option", "object", "video", "audio", "canvas", "svg", "datalist><option"):
        assert cut(f"<body><div>a</div><{tag}>hidden<p>one</p><p>two</p></body>") == ["a", "one", "two"], tag
    # those that are closed hide all they hold, also after one that is not
    assert cut("<button><div>menu</div></button><p>one") == ["one"]
    assert cut("<button>x<p>one</p><button><p>menu</p></button><p>two") == ["one", "two"]
    assert cut("<select><option>x<option>y</select><p>one") == ["one"]
    assert cut("<object><object><p>f</p></object><p>g</p></object><p>one") == ["one"]
    assert cut("<!-- </button> --><button>x<p>one") == ["one"]
    assert len(cut("<button><p>x" * 20_000)) == 20_000


def test_likeness_is_fine_enough(spark):
    """Pairs of 60 words with 40 in common: likeness 0.5."""
    rows = [(k, k * 100 + i, int(i < 60), int(i < 40 or i >= 60)) for k in range(300) for i in range(80)]
    words = spark.createDataFrame(rows, "doc_id long, term long, own int, edited int")
    got = fingerprint.fingerprints(words, "doc_id", ["own", "edited"])
    near = [r.x for r in got.select(fingerprint.likeness(got.own, got.edited).alias("x")).collect()]
    assert fingerprint.SAMPLES >= 32
    assert abs(np.mean(near) - 0.5) < 0.02 and np.sqrt(np.mean(np.square(np.array(near) - 0.5))) < 0.09


def test_language_sample_of_copies(spark):
    """A language is learnt from distinct texts, however often each of them is there."""
    docs = [(i, "one text that all rows of a language share", "a") for i in range(3000)]
    docs += [(i, f"text {i % 3} of three", "b") for i in range(3000)]
    docs += [(i, f"text of its own, number {i}", "c") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    s = langid.Settings(per_language=50)
    got = langid.training_sample(df, s)
    assert {k: sum(x == k for _, x in got) for k in "abc"} == {"a": s.windows, "b": 3 * s.windows, "c": 50 * s.windows}
    assert len({w for w, x in got if x == "b"}) == 3
    # rows in another order or more copies change nothing
    assert langid.training_sample(df.unionAll(df).repartition(5), s) == got


def test_few_explicit_pages_among_many(spark, monkeypatch):
    rows = [(i, f"<body><div>page {i}</div></body>") for i in range(2000)]
    rows += [(5000 + i, f"<body><main><p>explicit {i % 3}</p></main></body>") for i in range(600)]
    monkeypatch.setattr(pages, "train", lambda sample, s: sample)
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = [[b.text for b in p] for p in pages.learn(df, pages.Settings(pages=20))]
    assert got == [["explicit 0"], ["explicit 1"], ["explicit 2"]]
    assert len(pages.learn(df, pages.Settings(pages=2))) == 2
    assert pages.learn(df.where("page_id < 5000")) == []


def test_long_pages_are_learnt_to_their_end(monkeypatch):
    html = "<body><article>" + "".join(f"<p>text {i}</p>" for i in range(150)) + "</article><footer>" + "<p>end</p>" * 50 + "</footer></body>"
    page, seen, features = pages.cut_blocks(html), [], pages.features
    monkeypatch.setattr(pages, "features", lambda blocks, s: (seen.extend(blocks), features(blocks, s))[1])
    pages.train([page], pages.Settings(steps=5))
    assert {id(b) for b in page[60:]} & {id(b) for b in seen}


def test_more_languages_than_are_learnt(spark):
    rows = [(f"text {i} of language {k}", f"l{k:03d}") for k in range(30) for i in range(2 + k % 3)]
    df = spark.createDataFrame(rows, "text string, lang string")
    s = langid.Settings(languages=8, per_language=5, steps=5)
    got = {lang for _, lang in langid.training_sample(df, s)}
    assert got == {f"l{k:03d}" for k in range(2, 30, 3)[:8]}
    assert len(langid.learn(df.withColumn("doc_id", df.text), s).languages) <= 8
