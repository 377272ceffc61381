import time

from surprisal.llm.html_extract import leaves


def blocks(page):
    return [x.text for x in leaves(page)]


def test_an_open_control_does_not_hide_the_page():
    for name in ("button", "select", "object", "svg", "canvas", "audio", "video"):
        page = f"<body><nav><a href=x>Home</a> <{name}>Menu</nav><article><p>First one.</p><p>Second <{name}>x<b>y</b></{name}> one.</p></article></body>"
        assert blocks(page) == ["Home", "First one.", "Second one."], name
    assert blocks("<body><button>Menu<div>Text.</div><p>More.") == ["Text.", "More."]
    assert blocks("<div>a<button>b<div>c</div></button>d</div>") == ["a d"]


def test_text_of_math_stays():
    assert blocks("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>") == ["So x=2 holds."]


def test_raw_text_reaches_to_the_end():
    for name in ("script", "style", "textarea", "title"):
        assert blocks(f"<p>Text.</p><{name}><p>no text</p>") == ["Text."]


def test_open_controls_by_the_thousand():
    start = time.time()
    assert blocks("<p>a</p>" + "<svg><canvas><button>" * 20000 + "<p>b</p>") == ["a", "b"]
    assert time.time() - start < 20
