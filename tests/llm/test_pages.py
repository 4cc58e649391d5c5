"""Pages in layouts that the labeller was not fitted on, and markup that is easily misread."""

import pytest

from changemap.llm import html_text

SF = "/root/testdata/sf0.001"
HEAD = "A plain heading about rivers"
BODY = ["The river rises in the hills, and it falls to the sea after many miles.", "Its water was measured for years; the record shows a slow change."]
OTHER = "Please read what else we wrote this week, all of it is here for you."


@pytest.fixture(scope="module")
def model(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"))


def texts(page):
    return [b.text for b in html_text.blocks_of(page)]


def test_markup_that_is_easily_misread():
    assert texts('<p title="a > b">one</p>') == ["one"]
    assert texts("<p title='it is > \"b\"' class=x>one</p>") == ["one"]
    assert texts('<p title="open>one</p>') == ["one"]
    assert texts("<header><svg><path d='x'><p>one</p></header><p>two</p>") == ["one", "two"]
    assert texts("<p>a<svg><title>t</title><svg><text>x</text></svg><text>y</text></svg>b</p>") == ["ab"]
    assert texts("<p>a<svg><text>x") == ["a"]
    assert texts("<p>The area is <math><mi>a</mi><mo>+</mo><mn>2</mn><annotation>a+2</annotation></math> in all</p>") == ["The area is a+2 in all"]
    assert texts("<noscript><p>one</p><template><p>two</p>") == ["one", "two"]
    assert texts("<head><title>t</title></head><p>one<script>var a = '<p>'</script> two<style>p{}") == ["one two"]


def test_very_deep_and_long_pages(spark, model):
    deep = "<nav>" + "<div>" * 3000 + f"<p>{OTHER}</p>" + "</div>" * 3000 + "</nav>" + "".join(f"<p>{x}</p>" for x in BODY)
    assert len(html_text.Features().of(html_text.blocks_of(deep))[0][0]) < 20
    pages = spark.createDataFrame([(1, "<p>x</p>" * 50_000), *((i, f"<article><p>{BODY[0]}</p></article>") for i in range(2, 130))], "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in html_text.extract(pages.coalesce(1), model).collect()}
    assert len(got) == 129 and set(got[1]) <= {"x", "\n"} and all(got[i] == got[2] for i in range(3, 130))


@pytest.mark.parametrize("around", [
    '<nav><div><div><ul class="menu"><li class="menu-item">{o}</li><li class="menu-item"><a href="/">Home</a></li></ul></div></div></nav>{m}',
    '{m}<section class="comments-area"><ol><li><article class="comment-body"><p>{o}</p></article></li></ol></section>',
    '{m}<footer><div><div><p>{o}</p></div></div></footer>',
    '{m}<aside class="sidebar"><div><p>{o}</p></div></aside>',
    '<div class="cookie-notice"><p>{o}</p></div>{m}',
    '{m}',
])
@pytest.mark.parametrize("main", [
    '<article><h1>{h}</h1><p>{a}</p><p>{b}</p></article>', '<div class="post"><h1>{h}</h1><p>{a}</p><div><p>{b}</p></div></div>',
    '<div><div><div><h1>{h}</h1><p>{a}</p><p>{b}</p></div></div></div>',
])
def test_layouts(model, main, around):
    page = "<html><body>" + around.format(o=OTHER, m=main.format(h=HEAD, a=BODY[0], b=BODY[1])) + "</body></html>"
    blocks = html_text.blocks_of(page)
    p = model.scores([html_text.Features().of(blocks)])[0]
    assert [b.text for b, x in zip(blocks, p) if x > 0.5] == [HEAD, *BODY]


def test_two_paragraphs_in_plain_elements(model):
    blocks = html_text.blocks_of(f"<div><div><p>{BODY[0]}</p><p>{BODY[1]}</p></div></div>")
    assert (model.scores([html_text.Features().of(blocks)])[0] > 0.5).all()
