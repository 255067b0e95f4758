"""YAML events on small texts."""

import pytest

from sparrowdeck.sources import yaml


def short(text):
    """Events as short signs: +DOC, +MAP, =value with its style's first letter."""
    signs = {"document-start": "+DOC", "document-end": "-DOC", "mapping-start": "+MAP", "mapping-end": "-MAP", "sequence-start": "+SEQ", "sequence-end": "-SEQ"}
    style = {"plain": ":", "single-quoted": "'", "double-quoted": '"', "literal": "|", "folded": ">"}
    out = []
    for e in yaml.events(text):
        props = (f"&{e.anchor} " if e.anchor else "") + (f"{e.tag} " if e.tag else "")
        out.append(props + (f"={style[e.style]}{e.value}" if e.event == "scalar" else f"*{e.value}" if e.event == "alias" else signs[e.event]))
    return out[1:-1] if out.count("+DOC") == 1 else out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 1\nb: x y # c\n", ["+MAP", "=:a", "=:1", "=:b", "=:x y", "-MAP"]),
        ("- a\n- - b\n  - c\n-\n- d: e\n  f: g\n", ["+SEQ", "=:a", "+SEQ", "=:b", "=:c", "-SEQ", "=:", "+MAP", "=:d", "=:e", "=:f", "=:g", "-MAP", "-SEQ"]),
        ("k:\n- 1\n- 2\nz:\n", ["+MAP", "=:k", "+SEQ", "=:1", "=:2", "-SEQ", "=:z", "=:", "-MAP"]),
        ("a:\n  b:\n    c: d\n  e: f\n", ["+MAP", "=:a", "+MAP", "=:b", "+MAP", "=:c", "=:d", "-MAP", "=:e", "=:f", "-MAP", "-MAP"]),
        ("[a, [b], {c: d, e}, f: g]", ["+SEQ", "=:a", "+SEQ", "=:b", "-SEQ", "+MAP", "=:c", "=:d", "=:e", "=:", "-MAP", "+MAP", "=:f", "=:g", "-MAP", "-SEQ"]),
        ("{a: [1,\n 2], \"b\": 'c'}", ["+MAP", "=:a", "+SEQ", "=:1", "=:2", "-SEQ", '="b', "='c", "-MAP"]),
        ("a: 'it''s'\nb: \"x\\ty\\u0041\"\n", ["+MAP", "=:a", "='it's", "=:b", '="x\tyA', "-MAP"]),
        ("a: one\n  two\n\n  three\nb: 1", ["+MAP", "=:a", "=:one two\nthree", "=:b", "=:1", "-MAP"]),
        ('"one\n  two\n\n  three"', ['="one two\nthree']),
        ("a: |\n  x\n   y\n\n  z\n\nb: >-\n  p\n  q\n\n  r\n", ["+MAP", "=:a", "=|x\n y\n\nz\n", "=:b", "=>p q\nr", "-MAP"]),
        ("a: |+\n  x\n\nb: |-\n  y\n", ["+MAP", "=:a", "=|x\n\n", "=:b", "=|y", "-MAP"]),
        ("- |1\n  x\n- y", ["+SEQ", "=| x\n", "=:y", "-SEQ"]),
        ("a: &x\n  b: 1\nc: *x\nd: &y !t v\n", ["+MAP", "=:a", "&x +MAP", "=:b", "=:1", "-MAP", "=:c", "*x", "=:d", "&y !t =:v", "-MAP"]),
        ("&k key: v", ["+MAP", "&k =:key", "=:v", "-MAP"]),
        ("? a\n: b\n? c\n", ["+MAP", "=:a", "=:b", "=:c", "=:", "-MAP"]),
        ("--- a\n--- !!str b\n...\n---\nc: d\n", ["+DOC", "=:a", "-DOC", "+DOC", "!!str =:b", "-DOC", "+DOC", "+MAP", "=:c", "=:d", "-MAP", "-DOC"]),
        ("%YAML 1.2\n---\nhttp://x.y:80/z: a:b\n", ["+MAP", "=:http://x.y:80/z", "=:a:b", "-MAP"]),
        ("", []),
        ("# nothing\n", []),
    ],
)
def test_events(text, want):
    assert short(text) == want


@pytest.mark.parametrize("text", ["a: [1, 2", "a: 'x", "a: b: c", "a: *none", "\ta: 1", "a: 1\n  b: 2", "[a, , b]", '"\\q"', "a: @x"])
def test_errors(text):
    with pytest.raises(yaml.YamlError):
        yaml.events(text)


def test_pairs():
    assert yaml.pairs("a: &x\n  b: 1\n  c: ~\nd: *x\ne: []\nf: [p, {q: r}]\n") == [("a:b", "1"), ("a:c", None), ("d:b", "1"), ("d:c", None), ("e", None), ("f:0", "p"), ("f:1:q", "r")]
    for bad in ("- a", "a: 1\nA: 2"):
        with pytest.raises(yaml.YamlError):
            yaml.pairs(bad)
