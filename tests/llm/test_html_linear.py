"""Broken pages of a megabyte are read in seconds, and nothing of an article is lost in them."""

import time

import pytest

from ostrakon.llm import htmlcrf as c
from ostrakon.llm.htmltree import parse, text_of

N = 1_000_000


@pytest.mark.parametrize("unit", [
    "<a ", '<a "', "<a '", "<a \"'", "<span>", "<span><div>", "<b></i>", "<title>", "<li><b>", "<!-", "<!", "<!--", "</", "<svg>", "<svg><p>", "<td><table>", "<p><button>", '<a x="', "<a =", "<a     ", "</title ", "&lt", "<", "<div/>", "<a x='\">",
])
@pytest.mark.parametrize("tail", ["", "</b>" * 50_000, "<p>" * 50_000, '"\'>'])
def test_a_broken_megabyte(unit, tail):
    start = time.time()
    parse(unit * (N // len(unit)) + tail)
    assert time.time() - start < 20


def test_long_broken_pages_are_extracted():
    words = "The quick brown fox jumps over the lazy dog, and then it rests for a while in the warm sun. " * 4
    page = "<html><body><article>" + f"<p>{words}</p>" * 3 + "</article>" + "<span>" * 20_000 + "<a " * 100_000
    start = time.time()
    assert len(c.extract([page], c.trained())) == 1
    assert time.time() - start < 60


@pytest.mark.parametrize("page,want", [
    ('<p>a <b title="x>y">b</b></p>', "a b"), ('<p>a <b title="x>b</b> c</p>', "a b c"), ("<p>a < b</p>", "a < b"), ("a <b", "a <b"), ("a<!-- x > y -->b", "ab"), ("a<!doctype html>b", "ab"), ("<b>x</i>y</b>z", "xyz"),
])
def test_marks_and_quotes(page, want):
    assert text_of(parse(page)) == want
