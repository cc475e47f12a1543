import time

import pytest

from tickertone.llm import dom, extraction
from tickertone.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return extraction.default_model()


def texts(page):
    return [b.text for b in dom.leaf_blocks(page)]


def test_blocks():
    assert texts(None) == texts("") == texts("<p> \n </p>") == []
    assert texts("a &amp;&lt;b&gt; &eacute;&#x41;&nbsp; c\n d") == ["a &<b> éA c d"]
    assert texts("<p>a<b>b</b>c<br>d<p>e") == ["abc d", "e"]
    assert texts('<p title="x > y">a</p><!-- <p>no</p> --><script>var t="</p><p>";</script><style>p{}</style>b') == ["a", "b"]
    assert texts("1 < 2 <p>x<table><tr><td>u<td>v</table>y") == ["1 < 2", "x", "u", "v", "y"]
    assert texts("<textarea>t</textarea><select><option>o</select><p hidden>h</p><noscript><p>n</p></noscript>z") == ["t", "z"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul></nav></p>d") == ["a", "b", "c", "d"]
    assert texts("<p>open <a href='x>y") == ["open y"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]
    assert len(texts("<p>" + "word " * 100_000)[0]) == 499_999


def test_links_and_names():
    block = dom.leaf_blocks('<nav class="Top-menu"><a href=x>one</a> two</nav>')[0]
    assert (block.tag, block.parent, block.around, block.linked) == ("nav", "", {"in:nav", "hint:navigation"}, 3)


def test_held_out_pages(model):
    right = total = 0
    for page in labelled_pages(120, seed=77):
        blocks = dom.leaf_blocks(page)
        found = model.decode(extraction.features(blocks))
        right += sum(a == (b.label == "main") for a, b in zip(found, blocks, strict=True))
        total += len(blocks)
    assert right / total >= 0.98


def test_viterbi_finds_the_best_labels(model):
    from itertools import product

    for page in labelled_pages(40, seed=5):
        blocks = extraction.features(dom.leaf_blocks(page))[:9]
        scores = [sum(model.weights.get(f, 0.0) for f in x) for x in blocks]

        def total(labels, scores=scores):
            return model.first[labels[0]] + sum(s * y for s, y in zip(scores, labels, strict=True)) + sum(model.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(product((0, 1), repeat=len(blocks)), key=total)
        assert total(tuple(model.decode(blocks))) == pytest.approx(total(best))


def test_rows(spark, model):
    page = '<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>First text here.</p><p>Second &amp; last text.</p></article><footer>&copy; site</footer>'
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", page, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extraction.extract(table, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    body = "Head\n\nFirst text here.\n\nSecond & last text."
    assert sorted(found.collect(), key=str) == sorted([(1, "u", body, len(body))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", body, len(body))], key=str)
    assert extraction.extract(table.limit(0), model).collect() == []


def test_hidden_inline_elements():
    assert texts("<p>a<span hidden>b</p><p>c</p><p>d</p>") == ["a", "c", "d"]
    assert texts('<p>a<span style="display:none">b<span>c</span>d</span>e</p>') == ["ae"]
    assert texts("<div>a<b hidden>b<i>c</i><p>d</p></b>e</div>f") == ["a", "e", "f"]
    assert texts("<p>a<span hidden>b<p>c") == ["a", "c"]
    assert texts("<ul><li>a<em hidden>x<li>b</ul>") == ["a", "b"]
    assert texts("<p>a<img hidden>b<span hidden/>c<span>d</span></p>") == ["abcd"]
    assert texts("<p>a<a hidden href=x>b</a>c") == ["ac"]
    assert texts("<p>a<span hidden>b<br>c</span>d<span>e</span>") == ["ade"]


def test_time_is_linear_in_depth():
    """A page of very many open elements, also hidden and inline ones, takes seconds and little memory."""
    begin = time.monotonic()
    assert len(texts("<div>w " * 100_000)) == 100_000
    assert len(texts("<div class=menu>w " * 50_000 + "</div>" * 50_000)) == 50_000
    assert texts("<span hidden>" * 50_000 + "w" + "</span>" * 50_000 + "x") == ["x"]
    assert texts("<svg>" * 20_000 + "<p>w") == ["w"]
    assert len(texts("<b hidden><div>w</div>" * 20_000)) == 0
    assert time.monotonic() - begin < 60


def test_marks_are_seen_in_the_whole_block():
    early, late = (extraction.features(dom.leaf_blocks(f"<div>{x}</div>"))[0] for x in ("All rights reserved. " + "w " * 200, "w " * 200 + "All rights reserved."))
    assert "mark:copyright" in early and "late:copyright" in late


#: Pages as others write them, with the text that is theirs.
OTHER_LAYOUTS = [
    (
        "<!doctype html><html lang=en><head><title>t</title></head><body><div id=masthead><a href=/>Home</a> <a href=/b>Blog</a></div>"
        "<div id=content><h1>A walk by the sea</h1><p>We left at dawn, before the heat came over the hills and the road filled with cars.</p>"
        "<p>By noon the wind had turned, and the boats came back one after the other to the small harbour.</p></div>"
        "<div id=footer>&copy; 2024 A. Writer. All rights reserved.</div></body></html>",
        ["A walk by the sea", "We left at dawn", "By noon the wind"],
        ["Home", "reserved"],
    ),
    (
        "<body><nav><ul><li><a href=/1>News</a><li><a href=/2>Sport</a></ul></nav><main><article><h2>Rain ends the drought</h2>"
        "<p>After eight months without a drop, rain fell on the valley for two days and filled the lower dam.</p><ul><li>The upper dam stays closed until the spring.</ul>"
        "<script>var x='<p>not text</p>'</script></article></main><aside><h3>Related</h3><a href=/3>Older story</a></aside><footer>Imprint</footer></body>",
        ["Rain ends the drought", "After eight months", "The upper dam"],
        ["News", "Sport", "not text", "Older story", "Imprint"],
    ),
    (
        "<body><div class='cookie-banner'>We use cookies to improve your visit. <button>Accept</button></div><div class='post'><h1>Bread without kneading</h1>"
        "<div class='entry'><p>Mix flour, water, salt and a little yeast in the evening, cover the bowl and leave it on the table.</p>"
        "<p>In the morning fold the dough twice, let it rest and bake it in a closed pot for forty minutes.</p></div></div>"
        "<div class='comments'><p>Anna: I tried this and it came out flat.</p></div></body>",
        ["Bread without kneading", "Mix flour", "In the morning"],
        ["cookies", "Accept", "Anna"],
    ),
]


@pytest.mark.parametrize("page, kept, gone", OTHER_LAYOUTS)
def test_pages_of_other_layouts(model, page, kept, gone):
    text = extraction.main_text(page, model)
    assert [x for x in kept if x not in text] == [] and [x for x in gone if x in text] == []
    assert text.startswith(kept[0])


def test_hidden_elements_that_are_not_closed():
    assert texts("<html><head><meta charset=x><title>t</title><script>s</script><body><p>a<p>b</html>") == ["a", "b"]
    assert texts("<head><title>t</title><link href=x><p>a</p>b") == ["a", "b"]
    assert texts("<head><title>t</title><a href=x>a</a> b") == ["a b"]
    assert texts("<head> \n <title>t</title> plain <p>a") == ["plain", "a"]
    assert texts("<head><title>t</title></head><p>a") == ["a"]
    assert texts("<body><select><option>o<p>a</p>b") == ["a", "b"]
    assert texts("<body><select><option>o<div>a</div>b") == ["a", "b"]
    for tag in ("svg", "object", "video", "audio", "canvas", "math"):
        assert texts(f"<body><{tag}>no<p>a</p><div>b</div>") == ["a", "b"]
        assert texts(f"<body><div><{tag}>no</div><p>a</p>") == ["a"]
        assert texts(f"<body><{tag}><p>no</p></{tag}><p>a</p>") == ["a"]
