"""WARC round trips and page texts."""

import hashlib

import numpy as np
import pytest

from arbora.llm import dom, html_text, warc

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(frame, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "GAP", 10)
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "n", long),
            (2, None, long), (7, "v", "x" * 200000)] + [(i, "w", f"page {i} " * 20) for i in range(10, 60)]
    df = frame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.record_types(df), folder)
    out = warc.read_records(index, folder, with_payload=True).collect()
    assert len(out) == len(rows)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = 1 if h == long and i != 1 else None
        want.append((i or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=repr)
    texts = {r.page_id: r.payload for r in out}
    assert texts[1] == long and texts[2] is None and texts[5] == "" and texts[7] == "x" * 200000
    some = warc.read_records(index.where("page_id in (7, 20, 21)"), folder).collect()
    assert sorted(r.page_id for r in some) == [7, 20, 21]
    assert warc.archived(df.limit(0)).count() == 0


def test_coalesced_ranges(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 5)
    monkeypatch.setattr(warc, "RANGE", 100)
    assert list(warc.coalesced([0, 10, 30, 90], [10, 15, 50, 40])) == [(0, 80, [0, 1, 2]), (90, 130, [3])]


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


def scores(trees, make):
    """Precision and recall of the text blocks of composed pages."""
    made = [make.page() for _ in range(150)]
    hit = false = missed = 0
    for page, text in zip(made, html_text.page_texts(made, trees)):
        nodes = dom.parse(page)
        truth = [x.text for x, y in zip(nodes, dom.labels(nodes)) if y and x.tag == dom.TEXT]
        got = text.split("\n") if text else []
        hit += len(set(truth) & set(got))
        false += len(set(got) - set(truth))
        missed += len(set(truth) - set(got))
    return hit / (hit + false), hit / (hit + missed)


@pytest.fixture(scope="module")
def sentences(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()]
    texts = [x.text for p in pages for x in dom.parse(p) if x.tag == dom.TEXT]
    return sorted({s for t in texts for s in html_text._SENTENCE.split(t) if 0 < len(s) < 300})


#: Names of parts in other languages, none of which the library lists.
UNSEEN = {"main": "artikel inhalt contenido texte", "menu": "menue barre menyu hauptnav", "advert": "werbung anzeige publicidad reklama",
          "footer": "fusszeile pie pata pied", "header": "kopf cabecera kopfzeile entete", "side": "seitenleiste lateral marginal randspalte",
          "comment": "kommentare comentarios avis meinungen", "notice": "hinweis aviso meldung avertissement",
          "form": "formular formulario anmeldung recherche", "share": "teilen compartir partager weitersagen"}


def test_held_out_layouts(trees, sentences):
    precision, recall = scores(trees, html_text.Layouts(sentences, 77, invented=0))
    assert precision > 0.95 and recall > 0.85


def test_held_out_layouts_with_unseen_names(trees, sentences):
    assert not {w for words in UNSEEN.values() for w in words.split()} & {w for words in dom.HINTS.values() for w in words.split()}
    precision, recall = scores(trees, html_text.Layouts(sentences, 78, names=UNSEEN, invented=0))
    assert precision > 0.85 and recall > 0.8, (precision, recall)


def test_trees_of_an_empty_table(spark, frame):
    none = frame([], "page_id long, url string, html string")
    trees = html_text.train(none)
    assert html_text.extract(none, trees).count() == 0
    one = frame([(1, "u", "<p>Only this.</p>")], "page_id long, url string, html string")
    assert html_text.extract(one, trees).first().page_id == 1


def test_page_by_hand(frame, trees):
    page = ('<body><div id="cookie-consent"><p>We use cookies here. Accept?</p></div><nav><a href=1>Home</a></nav><div class="post-content">'
            "<h1>The  title</h1><p>First paragraph&nbsp;of the story &amp; more, long enough to be read as prose.<p>Second <b>one</b>, it goes on for a while &lt;here&gt;."
            '<div class="ad">Buy now!</div></div><div class="comments"><div class="comment"><p>I agree with all of it.</p></div></div>'
            "<script>var a = '<p>no</p>';</script><footer>All rights reserved.</footer>")
    df = frame([(1, None, page, "t"), (2, "u", None, "t"), (None, "u", "", "t"), (3, "u", "<script>x", "t"), (3, "u", "<<>>&&<p", "t")],
               "page_id long, url string, html string, text string")
    out = html_text.extract(df, trees).collect()
    assert out[0].text == ("The title\nFirst paragraph of the story & more, long enough to be read as prose.\n"
                           "Second one, it goes on for a while <here>.")
    assert out[0].n_chars == len(out[0].text) and [r.text for r in out[1:4]] == ["", "", ""] and len(out) == 5
    assert html_text.extract(df.limit(0), trees).count() == 0


def test_decoding_keeps_no_node_below_a_left_out_one():
    nodes = dom.parse("<div><p>a</p><div><p>b</p><p>c</p></div></div><div><p>d</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        p = rng.uniform(size=len(nodes))
        choice = dom.decoded(nodes, p)
        assert all(not choice[k] or k == 0 or choice[x.parent] for k, x in enumerate(nodes))
        best = -np.inf
        for bits in range(1 << len(nodes)):  # all choices
            c = [(bits >> k) & 1 for k in range(len(nodes))]
            if all(not c[k] or k == 0 or c[x.parent] for k, x in enumerate(nodes)):
                best = max(best, sum(np.log(p[k] if c[k] else 1 - p[k]) for k in range(len(nodes))))
        assert np.isclose(best, sum(np.log(p[k] if choice[k] else 1 - p[k]) for k in range(len(nodes))), atol=1e-6)


@pytest.mark.parametrize("page, blocks", [
    ("<p class=don't>Hello world</p><p>it's fine</p>", ["Hello world", "it's fine"]),
    ("<p>x</p><audio controls><p>rest one</p>", ["x", "rest one"]),
    ("<p>area <math><mi>a</mi><mo>=</mo><mi>b</mi></math> here</p>", ["area a=b here"]),
    ("<p>a</p><svg><text>no</text></svg><p>b</p><svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><noscript><p>no</p></noscript><template><p>no</p></template><p>b</p>", ["a", "b"]),
    ("<p>a</p><script>if (a < b) '</p>'</script ><p>b</p><style>p > q", ["a", "b"]),
    ("<p title=\"a > b\" data-x='c > d' e = f>kept</p>", ["kept"]),
    ("<p a=\"1\"b='2'c=3/>t</p><p =x>u</p><p \"q\">v</p>", ["t", "u", "v"]),
    ("<p title='never closed>lost</p><p>all", []),
    ("<canvas>drawn</canvas><object data=x><p>instead</p></object>", ["drawn", "instead"]),
    ("", []), (None, []), ("plain &amp; simple", ["plain & simple"]),
])
def test_blocks_of_odd_markup(page, blocks):
    assert [x.text for x in dom.parse(page) if x.tag == dom.TEXT] == blocks


def test_tags_of_any_length_are_parsed_in_linear_time():
    import time
    start = time.time()
    assert not any(x.text for x in dom.parse("<p " + "a='1' b=2 / = " * 40_000))
    assert len(dom.parse("<p " + "a=\"x\"" * 40_000 + ">t")) == 3
    assert time.time() - start < 5


def test_urls_with_line_breaks_come_back(frame):
    urls = ["http://a/\r\nx", "http://b/%0D", "", None, "é \n"]
    df = frame([(i, u, "html") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.archived(df).collect()} == dict(enumerate(urls))
