import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from soilcast.llm import html_text as H, langid as L, warc as W

from .helpers import SF, awkward, empty

PAGES = "page_id long, url string, html string, text string, digest string, part string"


def test_main_text_of_every_page(spark):
    """The pages' article by plain cutting of their known layout."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in df.collect():
        a = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html or "", re.S)
        parts = re.split(r"</?(?:h1|p)>", a[1]) if a else []
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip()
                 for x in parts]
        want[r.page_id] = "\n\n".join(x for x in parts if x)
    got = H.extract(df).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "A sentence, with commas, that runs on for a while, as prose does, until it ends somewhere. " * 3


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; text", "plain & text"), ("<p>x", "x"), ("<script>1</script>", ""),
    ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<p>a &#233; &lt;b&gt; &zzz;", "a é <b> &zzz;"),
    (f"<nav>menu</nav><div><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>"
     f"<div id=comments><p>{LONG}{LONG}{LONG}</p></div><footer>f</footer>",
     LONG.strip() + "\n\n" + LONG.strip()),
    (f"<div><a href=x>{LONG}</a> <a href=y>{LONG}</a></div><div><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><header><h1>T</h1></header><p>one</p><section><p>{LONG}</p></section><form>f</form></article>",
     "T\n\none\n\n" + LONG.strip()),
    ("<div>" * 5000 + "<p>deep</p>", "deep"), ("<p>a<br>b  \n c</p><!-- x <p>y", "a b c"),
    ("<article><p>x <b>y</p><p>z</b></p></article", "x y\n\nz")])
def test_tree_scoring_cases(page, text):
    assert H.main_text(page) == text


ART = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
TEXT = f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize("before, after", [
    ("<form id=aspnetForm>", "<input value=x><button>Go</button></form>"),
    ("<div id='content-sidebar-wrap'>", "</div>"), ("<div class='page-header-wrap'>", "</div>"),
    ("<div id='page-search-main'>", "</div>"), ("<div role=main class='page-menu-open'>", "</div>"),
    ("<div class=related-work><div class=notice-period>", "</div></div>"),
    ("<div id='content-sidebar-wrap'><article>", "</article><div class=sidebar><p>Short.</p></div></div>"),
    ("<nav><a href=x>menu</a></nav><article>", f"<div class=commentlist><p>{LONG}</p></div></article>"),
    ("<article>", f"<div><article class=comment><p>{LONG}</p></article></div></article>"),
    ("<article>", f"</article><article class='comment odd'><p>{LONG}{LONG}{LONG}</p></article>"),
    ("<article>", f"<section id=readerComments><p>{LONG}{LONG}</p></section></article>"),
    ("<article>", "</article><p>Copyright 2024 Somebody</p>"), ("<article>", "</article><p>Short words beside</p>"),
    ("<article>", f"</article><aside><p>{LONG}{LONG}</p></aside><div class=cookiebar><p>We use cookies.</p></div>"),
    ("<div class=cookieBanner><p>We use cookies.</p></div><main>", "</main><footer><p>All rights.</p></footer>"),
    ("<form action=/search><label>Find</label><input></form><div>", "</div>")])
def test_wrappers_and_comments(before, after):
    """No article is lost to the name or tag around it; reader comments, notices and forms go."""
    page = f"<html><body>{before}{ART}{after}</body></html>"
    assert H.main_text(page) == TEXT


def test_a_label_in_a_paragraph_and_pages_of_doubted_parts_only():
    assert H.main_text(f"<article><p>a <label>b</label> c, {LONG}</p></article>") == f"a b c, {LONG.strip()}"
    two = f"<div class=widget><p>{LONG}</p></div><div class=promo><p>{LONG}</p></div>"
    assert H.main_text(two) == f"{LONG.strip()}\n\n{LONG.strip()}"
    assert H.main_text("<aside><p>only this</p></aside>") == "only this"
    assert H.main_text("<div id=comments><p>no</p></div>") == ""


def test_html_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t", "d", "p"), (None, "u", "<p>x", None, None, None),
                                (1, None, None, "t", "d", "p")], PAGES)
    got = sorted(map(tuple, H.extract(df).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "u", "x", 1)], key=repr)
    assert H.extract(df.limit(0)).count() == 0


def test_languages_of_one_and_two_documents(spark):
    """A language with fewer training documents than the floor keeps its n-grams."""
    import zlib

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    pl = "zażółć gęślą jaźń, chrząszcz brzmi w trzcinie w szczebrzeszynie i źdźbło"
    cy = "mae hen wlad fy nhadau yn annwyl i mi, gwlad beirdd a chantorion"
    en = "the quick brown fox jumps over the lazy dog and then it sleeps for a while"
    rows = [(ids[0], pl, "pl"), (ids[1], pl + " szczęście", "pl"), (ids[2], cy, "cy")]
    rows += [(i, f"{en} number {i}", "en") for i in ids[3:40]] + [(1000, "źdźbło w trzcinie brzmi", None)]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[ids[0]], got[ids[1]], got[ids[2]], got[ids[5]], got[1000]) == ("pl", "pl", "cy", "en", "pl")


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = L.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_ignores_held_out_labels(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a = sorted(map(tuple, L.identify(df).collect()))
    spoilt = df.withColumn("lang", F.when(L.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, L.identify(spoilt).collect())) == a


def test_bloom_lookup_has_no_misses_and_known_false_rate(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(df, slots=1 << 12, grams=500)
    assert len(model.languages) == 4 and 0 < model.false_rate.max() < 0.2
    import numpy as np
    noise = "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(60000))
    found, total = model.hits(noise)
    assert np.abs(found / total - model.false_rate).max() < 0.01


def test_long_text_in_slices_equals_whole(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(df)
    texts = [r.text for r in df.limit(40).collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(L, "_SLICE", 50)
    assert [a for a, _ in model.predict(texts)] == [a for a, _ in whole]
    assert [b for _, b in model.predict(texts)] == pytest.approx([b for _, b in whole])


def test_language_awkward_rows(spark):
    df = awkward(spark)
    got = L.identify(df).collect()
    assert len(got) == df.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    assert not [r for r in got if r.doc_id is None and r.held_out]
    nothing = L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert L.identify(empty(spark)).count() == 0


def test_warc_round_trip_and_determinism(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    m = W.write_archives(df, str(tmp_path / "a"), shard_bytes=30_000)
    W.write_archives(df.repartition(5), str(tmp_path / "b"), shard_bytes=30_000)
    assert m.count() > 2 and not list(tmp_path.glob("a/archives/_temporary*"))
    back = {r.page_id: r for r in W.read_archives(spark, str(tmp_path / "a"), keep_payload=True).collect()}
    assert len(back) == df.count()
    for r in df.collect():
        payload, b = (r.html or "").encode(), back[r.page_id]
        assert (b.payload_bytes, b.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert b.url == r.url and (b.payload == payload if b.record_type == "response" else b.refers_to > r.page_id)
    ids = [r.page_id for r in W.read_archives(spark, str(tmp_path / "a")).collect()]
    files = {d: b"".join(p.read_bytes() for p in sorted((tmp_path / d / "archives").iterdir())) for d in "ab"}
    assert len(ids) == len(set(ids)) and files["a"] == files["b"]


def test_warc_awkward_rows(spark):
    x, page = "x" * 2000, "u"
    df = spark.createDataFrame(
        [(1, page, x, None, None, None), (1, page, x, None, None, None), (None, page, x, None, None, None),
         (None, None, None, None, None, None), (5, "a b\n", x, None, None, None), (5, "z", x, None, None, None),
         (6, page, "short", None, None, None), (7, page, "short", None, None, None)], PAGES)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in W.round_trip(df).collect()), key=repr)
    assert got == sorted([(1, "revisit", 5), (1, "revisit", 5), (None, "revisit", 5), (None, "response", None),
                          (5, "response", None), (5, "revisit", 5), (6, "response", None), (7, "response", None)],
                         key=repr)
    assert W.round_trip(df.limit(0)).count() == 0


def test_truncated_archive_is_noticed():
    import io

    rec = W.build_record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7)
    assert len(list(W.members(io.BytesIO(rec + rec)))) == 2
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(rec + rec[:-20])))
