import pytest

from ostrakon.llm import htmlcrf as c
from ostrakon.llm.htmltree import parse, text_of


@pytest.mark.parametrize("page,want", [
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
    ("<p>a <svg><path d='1'/><text>label</text></svg> b</p>", "a label b"),
    ("<p>a <object>plain</object><noscript> text</noscript></p>", "a plain text"),
    ("<div><svg/><p>b</p></div>", "b"),
    ("<div><p>a <math><mi>x<p>b</p></div><p>c</p>", "a xbc"),
    ("<div><svg><path><p>b</p></div><p>c</p>", "bc"),
    ("<p>a</p><noscript><p>b</p><p>c</p>", "abc"),
    ("<p>a</p><template>b</template><iframe>d<p>c</p>", "abdc"),
])
def test_nothing_is_lost(page, want):
    assert text_of(parse(page)) == want


def test_a_block_ends_foreign_content():
    div = parse("<div><svg><path><p>b</p></div>").children[0]
    assert [x.tag for x in div.children] == ["svg", "p"]


def test_formulas_stay_in_the_extracted_article():
    words = "The quick brown fox jumps over the lazy dog, and then it rests for a while in the warm sun. " * 4
    formula = f"<p>{words} where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>Before. {words}<math><mi>y<p>After. {words}</p>"
    page = "<html><body><article>" + f"<p>{words}</p>" * 3 + formula + "</article></body></html>"
    text = c.extract([page], c.trained())[0]
    assert "where x=2 holds." in text and "After. The quick" in text
