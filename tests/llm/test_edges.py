"""Every operator and stage over nulls, empty and long texts, repeats, clashing names and no rows."""
import hashlib

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from messy_rows import LONG, messy, nothing  # noqa: F401
from mnemo.llm import fingerprint, forest, langid, linededup, lm, mixing, neardup, pages, pieces, secrets
from mnemo.llm.queries import piece_model

FAST = langid.Settings(steps=30, per_language=20)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_mixing(messy, nothing):
    plan = mixing.mix_sources(messy)
    rows = plan.collect()
    assert len(rows) == messy.count() and "lang" in plan.columns
    sizes = {}
    for r in rows:
        assert 0 <= r.copies <= 2
        assert r.size == len((r.text or "").split())
        sizes.setdefault(r.source, [r.source_size, r.target, 0, 0])
        sizes[r.source][2] += r.size
        sizes[r.source][3] += r.size * r.copies
    for source_size, target, own, _ in sizes.values():
        assert source_size == own and target <= 2 * source_size + 1e-9
    assert abs(sum(t for _, t, _, _ in sizes.values()) - 1.5 * sum(s for s, *_ in sizes.values())) < 1e-6 * LONG.count(" ")
    assert sorted(map(str, mixing.mix_sources(messy).collect())) == sorted(map(str, rows))  # reruns agree
    assert mixing.mix_sources(nothing).count() == 0
    mixed = mixing.emit_mix(messy)
    assert mixed.columns == messy.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.emit_mix(nothing).count() == 0


def test_language(messy, nothing):
    net = langid.learn(messy, FAST)
    got = langid.identify(messy, net, FAST, positions=True)
    assert [c for c in got.columns if c in messy.columns][:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in got.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in net.languages and 0 <= r.score <= 1
        assert len(r.byte_langs) == len((r.text or "").encode())
    assert langid.identify(nothing, net, FAST).count() == 0
    unlearnt = langid.identify(messy, langid.learn(nothing, FAST), FAST)
    assert {r.lang_pred for r in unlearnt.collect()} == {"und"}


def test_near_duplicates(messy, nothing):
    got = neardup.near_duplicates(messy.select("doc_id", "text"))
    assert ids(got) == ids(messy)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert {(r.component_id, r.kept) for r in by[1]} == {(1, True)}
    assert {(r.component_id, r.kept) for r in by[2]} == {(1, False)} and len(by[2]) == 2
    assert {(r.component_id, r.n_shingles) for i in (3, 4, 6, 11) for r in by[i]} == {(i, 0) for i in (3, 4, 6, 11)}
    assert by[9][0].component_id == 5  # one shingle more
    assert {(r.component_id, r.kept) for r in by[None]} == {(None, True)}
    assert neardup.near_duplicates(nothing.select("doc_id", "text")).count() == 0
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    assert ids(kept) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 10, 11)] + [(True, 0)] * 2


def test_fingerprints(messy, nothing):
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(messy).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert got[1].own == got[2].own and got[3].own is None and got[4].n_chars == 0
    assert got[11].next_id == 1 and len(got[5].own) == fingerprint.SAMPLES
    text = {r.doc_id: r.text or "" for r in messy.where("doc_id IS NOT NULL").collect()}
    for i, r in got.items():
        own, q = text[i], len(text[i]) // 4
        edited = own[:len(own) - q] + text[r.next_id][:q]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprint.fingerprint_edits(nothing).count() == 0
    one = fingerprint.fingerprint_edits(messy.where("doc_id = 1")).first()
    assert one.next_id == 1


def test_secrets(messy, nothing):
    got = secrets.scan_secrets(messy)
    assert ids(got) == ids(messy) and {len(r.found) for r in got.collect()} == {0}
    assert secrets.digest(secrets.scan_secrets(nothing)).count() == 0


def test_pieces(messy, nothing):
    got = pieces.encode_pieces(messy, piece_model())
    rows = got.collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = r.text or ""
        assert r.decoded == text and r.ids[-1] == 2 and len(r.ids) == len(r.ends)
        assert r.ends[-1] == len(text.encode()) and sorted(r.ends) == r.ends
    assert pieces.encode_pieces(nothing, piece_model()).count() == 0


def test_language_model(messy, nothing):
    model = lm.train(messy)
    got = lm.score(messy, model)
    assert ids(got) == ids(messy)
    for r in got.collect():
        n = len((r.text or "").split())
        assert r.n_tokens == n + 1 == r.n_known and r.score < 0 and r.base_score < 0
    empty = lm.score(messy.where("doc_id = 1"), lm.train(nothing)).first()
    assert (empty.n_known, empty.train_tokens, empty.score) == (0, 0, 0.0)
    assert lm.score(nothing, model).count() == 0


def test_line_dedup(messy, nothing):
    got = linededup.remove_repeated(messy)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == messy.count()
    assert rows[4][0].text is None and rows[4][0].n_lines == 0
    assert rows[3][0].text == "" and rows[1][0].n_removed == 0
    assert rows[2][0].text == rows[2][1].text  # repeated rows are one document
    assert linededup.remove_repeated(nothing).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [None, 1.0]),
            (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, []), (11, [-1.0, 0.0]), (12, [1.0, 0.0]), (12, [1.0, -0.0]), (None, [1.0, 0.0]),
            (13, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df).collect()), key=str)
    assert sorted(x for x in got if x[0] in (1, 2, 3, 12, 13)) == sorted(
        [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (12, 5, 1, False), (12, 5, 1, False), (13, 5, 1, False)])
    assert all(x[1] == 0 and x[2] == x[0] and x[3] for x in got if x[0] in (4, 5, 6, 7, 8, 9, 10, 11))
    assert [x for x in got if x[0] == 0] == [(0, 0, None, True)]
    assert forest.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    body = "".join(f"<p>Words in paragraph {i}, rather many of them.</p>" for i in range(5))
    page = f"<html><body><nav><ul><li><a>Home</a></li></ul></nav><article>{body}</article><footer>foot</footer></body></html>"
    rows = [(i, "u", page, "kept") for i in range(6)] + [(10, None, None, None), (11, "u", "", "k"), (12, "u", "<p>" * 3000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    fast = pages.Settings(steps=80)
    got = {r.page_id: r for r in pages.extract(df, pages.learn(df, fast), fast, blocks=True).collect()}
    assert got[10].text == got[11].text == got[12].text == ""
    assert got[0].text.count("\n\n") == 4 and "Home" not in got[0].text and "foot" not in got[0].text
    assert len(got[0].blocks) == 7
    assert pages.extract(df.limit(0), pages.learn(df.limit(0), fast), fast).count() == 0


@pytest.mark.parametrize("name,stage", C.STAGES[:-1])
def test_stages_keep_columns(spark, messy, nothing, name, stage, monkeypatch):
    monkeypatch.setattr(langid.learn, "__defaults__", (FAST,))
    out = stage(spark, messy, "unused")
    assert out.schema.names == messy.schema.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in messy.schema]
    rows = out.collect()
    assert {r["_text"] for r in rows} <= {"t", None} and {r["size"] for r in rows} <= {"x", None}
    assert stage(spark, nothing, "unused").count() == 0


def test_last_stage(spark, messy, nothing):
    out = C.STAGES[-1][1](spark, messy, "unused")
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and out.count() == messy.count()
    assert C.STAGES[-1][1](spark, nothing, "unused").count() == 0
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
