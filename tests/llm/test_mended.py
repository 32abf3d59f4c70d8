"""Faults found in earlier versions of the operators."""

import random

from ridelens.llm import block_labeller, language_id


def test_no_text_is_lost_inside_embedded_elements():
    text = lambda page: [b.text for b in block_labeller.blocks(page)]
    assert text("<p>Area is <math><mi>x</mi>=3</math> metres.</p>") == ["Area is x=3 metres."]
    assert text("<article><p>one</p><svg><text>two</text><p>three</p></article><p>four</p>") == ["one", "two", "three", "four"]
    assert text("<div><object>five</object> six <canvas>seven</canvas></div><noscript>eight</noscript>") == ["five six seven", "eight"]
    assert text("<article><p>one</p><div><iframe src=x>lost</div><p>two</p></article>") == ["one", "two"]
    assert text("<p>one</p><script>var x = '<p>no</p>';</script><p>two</p>") == ["one", "two"]


def test_whole_path_is_read():
    deep = "<article>" + "<div class='a b'>" * 40 + "<p>text</p>" + "</div>" * 40 + "</article>"
    other = deep.replace("article", "nav")
    hasher = block_labeller.Hasher()
    assert (hasher.vectors(block_labeller.blocks(deep)) != hasher.vectors(block_labeller.blocks(other))).any()


def test_rejection_bound_is_the_calibrated_one():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(30)).encode() for _ in range(200)]
    assert language_id.train(texts, [rng.choice("xy") for _ in texts]).least > 0.5
    assert language_id.train(texts, ["x"] * len(texts)).least <= 1.0
