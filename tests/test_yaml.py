"""The frontmatter reader: scalars, blocks, brackets, tags, anchors, failures."""

import pytest

from wicker.functions import yaml


def tree(source):
    """Entries as pointer -> (kind, value), the root left out."""
    return {p: (k, v) for p, k, v, _, _, _ in yaml.read(source)[1:]}


def texts(source):
    return {p[1:]: v for p, (k, v) in tree(source).items() if k == "str"}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('tags: ["a, b", c]\n', {"tags/0": "a, b", "tags/1": "c"}),
        ("tags: ['it''s', !!str alpha]\n", {"tags/0": "it's", "tags/1": "alpha"}),
        ('a: "\\u00e9\\t\\x41\\"\\\\ \\ud83d\\ude00"\n', {"a": 'é\tA"\\ 😀'}),
        ('"status": draft\n\'x y\' : z\n', {"status": "draft", "x y": "z"}),
        ("description: >\n  one\n  two\n\n  three\n", {"description": "one two\nthree\n"}),
        ("description: >-\n  one\n    more\n  two\n", {"description": "one\n  more\ntwo"}),
        ("a: |\n  x\n\n   y\nb: |+\n  z\n\nc: |2-\n    w\n", {"a": "x\n\n y\n", "b": "z\n\n", "c": "  w"}),
        ("a: &x hello\nb: *x\nc: [*x, &y w, *y]\n", {"a": "hello", "b": "hello", "c/0": "hello", "c/1": "w", "c/2": "w"}),
        ("a: one\n  two\n\n  three # note\nb: x#y\n", {"a": "one two\nthree", "b": "x#y"}),
        ('a: "one\n  two\\\n  three"\n', {"a": "one twothree"}),
        ("a:\n- x\n- y: 1\n  z: t\n-\n  - n\nb: u\n", {"a/0": "x", "a/1/z": "t", "a/2/0": "n", "b": "u"}),
        ("a: {b: c, 'd': [e, f: g], h: https://x.y/z?a=b}\n", {"a/b": "c", "a/d/0": "e", "a/d/1/f": "g", "a/h": "https://x.y/z?a=b"}),
        ("a: http://x/y:z\nb: a - b\nc: -x\n", {"a": "http://x/y:z", "b": "a - b", "c": "-x"}),
        ("flow: [\n  { label: !!str 'it''s', n: 2 }\n]\n", {"flow/0/label": "it's"}),
        ("a/b~c: x\n? q\n: w\n? only\n", {"a~1b~0c": "x", "q": "w"}),
        ("a: !!str 001\nb: !<tag:yaml.org,2002:str> 1\nc: ! 5\n", {"a": "001", "b": "1", "c": "5"}),
        ("t: !!timestamp 2001-12-15T02:59:43.1Z\nu: !!timestamp 2001-12-14 21:59:43.10 -5\n", {"t": "2001-12-15T02:59:43.100Z", "u": "2001-12-15T02:59:43.100Z"}),
        ("s: !!set {alpha: null, beta: null}\no: !!omap [{first: x}]\n", {"s/0": "alpha", "s/1": "beta", "o/0/first": "x"}),
        ("a: &o\n  child: !!str x\nb: *o\nempty: !!str |-\n\nlast: !!str |-\n  one\n  two\n# note\n\n\"c:k\": v # note\n", {"a/child": "x", "b/child": "x", "empty": "", "last": "one\ntwo", "c:k": "v"}),
        ("m: !!map &n\n  k: v\nq: !!seq [!!str &f x, *f]\nold: &s !!str 0.2\nnew: &s \"1.0\"\nuse: *s\n", {"m/k": "v", "q/0": "x", "q/1": "x", "old": "0.2", "new": "1.0", "use": "1.0"}),
        ("# only a note\na: x\n\n\n", {"a": "x"}),
    ],
)
def test_texts(source, want):
    assert texts(source) == want


def test_kinds():
    got = tree("i: 42\nh: 0x1F\nf: 4.2e1\nb: True\nn: ~\ne:\nz: !!int 9007199254740993\ny: !!float .inf\nd: 2026-07-01\nl: []\nm: {}\nx: -.5\n")
    assert got == {"/i": ("int", "42"), "/h": ("int", "31"), "/f": ("float", "4.2e1"), "/b": ("bool", "true"), "/n": ("null", ""), "/e": ("null", ""), "/z": ("int", "9007199254740993"), "/y": ("float", ".inf"), "/d": ("str", "2026-07-01"), "/l": ("seq", ""), "/m": ("map", ""), "/x": ("float", "-.5")}


@pytest.mark.parametrize(
    ("source", "place"),
    [
        ("type: [unterminated\n", (20, 21)), ("a: 'x\n", None), ("a: x\na: y\n", (5, 6)), ("- not\n- a mapping\n", (0, 18)), ("x\n", None), ("a: x\n1: y\n", (5, 6)), ("p:\n  1: n\n", (5, 6)),
        ("p: !runtime {}\n", None), ("a: .inf\n", None), ("a: *none\n", None), ('a: "\\q"\n', None), ("a: b: c\n", None), ("a: x\n  b: y\n", None), ("a:\n\tb: c\n", None), ("? [a]\n: b\n", None), ("a: @x\n", None),
        ("a: {b: 1, b: 2}\n", None), ("a: [x y: z, w\n", None), ("a: 'x' y\n", None), ("a: !!int x\n", None), ("true: x\n", (0, 4)), ("a: [b}\n", None), ("a:\n  - x\n  y: z\n", None), ("", (0, 0)), ("a: x\nb\n", None),
    ],
)
def test_failures(source, place):
    with pytest.raises(yaml.Failure) as found:
        yaml.read(source)
    assert not found.value.limit and place in (None, (found.value.start, found.value.end))


def test_places():
    source = "type: reference\n'x':  [a, b]\n"
    at = {p: source[s:e] for p, _, _, _, s, e in yaml.read(source)}
    assert at["/type"] == "type: reference" and at["/x"] == "'x':  [a, b]" and at["/x/1"] == "b"


@pytest.mark.parametrize("source", ["a: " + "x" * 70_000, "a: x\n" * 1 + "# n\n" * 4_001, "a: [" + "," .join(["!"] * 9_000) + "]", "a:\n" + " " * 130 + "b: c\n", "a: " + "[" * 70 + "]" * 70, "a: &a [" + ", ".join(["xxxxxxxxxx"] * 400) + "]\nb: [" + ", ".join(["*a"] * 60) + "]\n"])
def test_limits(source):
    with pytest.raises(yaml.Failure) as found:
        yaml.read(source)
    assert found.value.limit


def test_aliases_are_bounded():
    with pytest.raises(yaml.Failure, match="alias"):
        yaml.read("a: &a x\nb: [" + ", ".join(["*a"] * 101) + "]\n")
    assert len(yaml.read("a: &a x\nb: [" + ", ".join(["*a"] * 100) + "]\n")) == 103
