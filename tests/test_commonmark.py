"""Links, headings and code blocks of Markdown texts."""

import pytest

from wicker.functions import commonmark
from wicker.functions.yaml import Failure


def links(text):
    return [(label, target) for label, target, _, _ in commonmark.read(text)[0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\[no](a.md) [yes](b.md)", [("yes", "b.md")]), ("[one [two] three](a.md)", [("one [two] three", "a.md")]), ("[p](x(1).md)", [("p", "x(1).md")]), ("[p](x(1.md)", []), ("[e](a&amp;b.md)", [("e", "a&b.md")]),
        ("    [code](a.md)\n", []), ("para\n    [lazy](a.md)\n", [("lazy", "a.md")]), ("<div>\n[raw](a.md)\n</div>\n\n[ok](b.md)", [("ok", "b.md")]), ("```\n[x](a.md)\n```\n[y](b.md)", [("y", "b.md")]), ("~~~\n[x](a.md)", []),
        ("`[x](a.md)` ``a`[y](b.md)``", []), ("![img](i.png) ![a [in](x.md)](y.png)", []), ("[![alt](i.png) t](a.md)", [("alt t", "a.md")]), ("[a [b](c.md) d](e.md)", [("b", "c.md")]), ("![x [a](b.md)", [("a", "b.md")]),
        ("[*em* **st** `co`](a.md 'title')", [("em st co", "a.md")]), ("[a](<b c.md> (t))", [("a", "b c.md")]), ("[a]( b.md\n\"t\" )", [("a", "b.md")]), ("[a](b c.md)", []), ("[a]()", [("a", "")]),
        ("[Full][t] [c][] [s]\n\n[T]: a.md\n[c]: b.md 'x'\n[s]: <c.md>\n[s]: d.md", [("Full", "a.md"), ("c", "b.md"), ("s", "c.md")]), ("[a][no] [b]\n\n[a]: x.md", []), ("[foo]: /u 'title\n\n[foo]", []), ("[foo]: /u\n'title\n\n[foo]", [("foo", "/u")]),
        ("<https://a.b/c?d> <x@y.org> <notalink>", [("https://a.b/c?d", "https://a.b/c?d"), ("x@y.org", "mailto:x@y.org")]), ("> [q](a.md)\n- [i](b.md)\n  1. [j](c.md)\n\n         [code](d.md)\n", [("q", "a.md"), ("i", "b.md"), ("j", "c.md")]),
        ("- a\n\n  [in](a.md)\n\n      [code](b.md)\n", [("in", "a.md")]), ("<!-- [x](a.md) -->\n[y](b.md)", [("y", "b.md")]), ("a <!-- [x](a.md) --> [y](b.md)", [("y", "b.md")]), ("<span title='[x](y.md)'>[z](w.md)</span>", [("z", "w.md")]),
        ("[a\nb](c.md)", [("a\nb", "c.md")]), ("[a  \nb](c.md)", [("a b", "c.md")]), ("[x]\n(y.md)", []), ("[\\]](z.md)", [("]", "z.md")]), ("*[a](b.md)*", [("a", "b.md")]), ("[a*b](c.md)*", [("a*b", "c.md")]), ("[snake_case_x](a_b.md)", [("snake_case_x", "a_b.md")]),
        ("# [h](a.md) #\n\n[s](b.md)\n===\n", [("h", "a.md"), ("s", "b.md")]), ("[a](b.md\\)c)", [("a", "b.md)c")]), ("[a](&#x61;.md)", [("a", "a.md")]), ("[d]: a.md\n[d]\n", [("d", "a.md")]), ("-   [w](a.md)\n\t[x](b.md)", [("w", "a.md"), ("x", "b.md")]),
        ("[a](b.md) | [c](d.md)", [("a", "b.md"), ("c", "d.md")]), ("1. one\n2. [two](t.md)\n\ntext\n3. [three](u.md)", [("two", "t.md"), ("three", "u.md")]), ("***[a](b.md)***", [("a", "b.md")]), ("[Größe 😀](ü.md)", [("Größe 😀", "ü.md")]),
    ],
)
def test_links(text, want):
    assert links(text) == want


def test_headings_and_code():
    text = "# One *two* #\nSet `x`\nmore\n---\n\n```\n# no\n```\n> ## Quoted\n\n    # code\n\n####### seven\n#no\n- ### In\n\n---\n##\n"
    _, headings, code = commonmark.read(text)
    assert [(h[0], h[1]) for h in headings] == [(1, "One two"), (2, "Set x\nmore"), (2, "Quoted"), (3, "In"), (2, "")]
    assert [fenced for _, fenced in code] == [True, False]
    assert text[headings[0][2] : headings[0][3]] == "# One *two* #" and text[headings[1][2] : headings[1][3]] == "Set `x`\nmore\n---"


def test_places():
    text = "é 😀 [a](b.md)\n\n> x\n> [c\n> d][e]\n\n[e]: f.md\n"
    assert [text[s:e] for _, _, s, e in commonmark.read(text)[0]] == ["[a](b.md)", "[c\n> d][e]"]


@pytest.mark.parametrize("text", ["x" * 300_000, "\n" * 20_002, "*" * 20_001, "[a](b.md) " * 5_001, "[" + "x" * 600 + "](a.md)", "[a](" + "x" * 3_000 + ")", "> " * 70 + "x"])
def test_limits(text):
    with pytest.raises(Failure) as found:
        commonmark.read(text)
    assert found.value.limit


def test_work_stays_in_proportion():
    for text in ("[" * 15_000, "*a " * 6_000, "[a](" * 4_000, "`" + "`a" * 5_000, "<" * 15_000, "![" * 7_000 + "]" * 5_000):
        commonmark.read(text)
