import random

import numpy as np

from weft.llm.boosting import fit
from weft.llm.dom import features, parse
from weft.llm.html_text import _MARK, decode, extract, main_texts, model, training_page


def runs(page):
    return [(n.tag, d.text.strip()) for d in parse(page) if d.tag == "#text" for n in [parse(page)[d.parent]]]


def test_parser():
    assert runs("<p>a<p>b</p>c<li>d<li>e") == [("p", "a"), ("p", "b"), ("#root", "c"), ("li", "d"), ("li", "e")]
    assert runs("<script>if (a<b) '</p>'</script><style>x</style><!-- <p>no</p> -->y") == [("#root", "y")]
    assert runs("<p title='a > b'>x &amp;lt; &copy;</p>") == [("p", "x &lt; ©")]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == [("td", "a"), ("td", "b"), ("td", "c")]
    assert runs("</div></p>x < y <b>z") == [("#root", "x < y z")]
    assert runs("") == [] and runs("<p") == [("#root", "<p")] and runs("<script>never ends") == []
    deep = parse("<div>" * 5000 + "x")
    assert deep[-1].depth == 5001 and features(deep).shape[0] == len(deep)


def test_decoding_is_consistent_and_best():
    r = random.Random(1)
    for _ in range(200):
        nodes = parse("".join(r.choice(["<div>", "</div>", "<p>", "x"]) for _ in range(8)))[:9]
        scores = np.array([r.uniform(-3, 3) for _ in nodes])
        kept = decode(nodes, scores)
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)
        best = 0.0
        for mask in range(1 << (len(nodes) - 1)):
            pick = [True, *(bool(mask >> i & 1) for i in range(len(nodes) - 1))]
            if all(pick[n.parent] for n, k in zip(nodes, pick) if k and n.parent >= 0):
                best = max(best, sum(s for s, k in zip(scores[1:], pick[1:]) if k))
        assert abs(scores[1:][kept[1:]].sum() - best) < 1e-9


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x[:1500], y[:1500]).log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_held_out_pages():
    r, right, total = random.Random(77), 0, 0
    for _ in range(100):
        nodes = parse(training_page(r))
        want = [_MARK in d.text for d in nodes]
        for d in nodes:
            d.text = d.text.replace(_MARK, "")
        kept = decode(nodes, model().log_odds(features(nodes)))
        right += sum(w == k for d, w, k in zip(nodes, want, kept) if d.tag == "#text")
        total += sum(d.tag == "#text" for d in nodes)
    assert right / total > 0.98


PAGE = (
    '<html><head><title>T</title><script>var x="</p>"</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div>'
    "<article><h1>A  title &amp; more</h1><p><b>First\n words</b> of the text, which goes on for a while.<br>Next.</p><p>Second part of the text, with more words in it.</p></article>"
    '<div class="comments"><p>Nice one!</p></div><footer>&copy; site</footer></body></html>'
)
TEXT = "A title & more First words of the text, which goes on for a while. Next. Second part of the text, with more words in it."


def test_page():
    assert main_texts([PAGE], model()) == [TEXT]


def test_rows(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (None, "u", "", 0), (1, "u", PAGE, 0), (3, "u", PAGE.replace("Second part", "Second " * 30_000 + "part"), 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    out = sorted(((r["page_id"], r["url"], r["text"][:40], r["n_chars"]) for r in extract(df).collect()), key=repr)
    long = TEXT.replace("Second part", "Second " * 30_000 + "part")
    assert out == sorted([(1, "u", TEXT[:40], len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (1, "u", TEXT[:40], len(TEXT)), (3, "u", TEXT[:40], len(" ".join(long.split())))], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_raw_text_and_fallbacks():
    assert runs("<p>Let <math><mi>x</mi></math> be <svg><text>drawn</text></svg> <object>fallback</object><noscript>here</noscript></p>") == [("p", "Let x be drawn fallbackhere")]
    assert runs("<p>a<!-- open <p>b") == [("p", "a")] and runs("x <p <!-- y") == [("#root", "x <p")]
    assert runs("<p title=\"a'>b\">c</p><p title='>d") == [("p", "c"), ("p", "d")]
    assert runs("<table><tr><td><p>a<tr><td>b</table>") == [("p", "a"), ("td", "b")]


def test_time_is_linear():
    import time

    shapes = ["<a b ", "<a href=\"x' ", "<a '\"> ", "</b><i>", "<h1><b>", "<p><select><h1>", "</x>", "<", "<!", "<p \">'", "<td><tr>", "&amp", "<div class='a b'>"]
    for shape in shapes:
        took = []
        for size in (200_000, 800_000):
            page = shape * (size // len(shape)) + ">"
            began = time.perf_counter()
            parse(page)
            took.append(time.perf_counter() - began)
        assert took[1] < 8 * took[0] + 2, (shape, took)


def test_very_long_pages():
    for shape in ("<a b ", "<a href=\"", "<i></b>"):
        assert len(main_texts([shape * (5_000_000 // len(shape)) + "<p>end of the page"], model())) == 1
