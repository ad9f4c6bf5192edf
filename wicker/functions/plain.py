"""The plainest documents, read by a few expressions: fields on one line each, and headings, paragraphs of one line and items of simple links.

front and body give what yaml.read and commonmark.read give, or None for any text beyond these forms, which those readers
then read. Every form here is one of which they say the same, so nothing depends on which of the two read a text.
"""

from __future__ import annotations

import re

from wicker.functions import yaml

#: Longest part of a document and longest link that are read here, far below every limit of the readers.
LONGEST, LONGEST_LINK = 4_000, 500
WORDS = frozenset("null Null NULL true True TRUE false False FALSE".split())
NAME = r"[A-Za-z_][A-Za-z0-9_]*+"
SCALAR = r"[A-Za-z0-9](?:[A-Za-z0-9_./+#-]|:(?=[A-Za-z0-9])| (?=[A-Za-z0-9]))*+"
FIELD = re.compile(rf'({NAME}): (?:"([ !#-\[\]-~]*+)"|({SCALAR})|\[({SCALAR}(?:, {SCALAR})*+)\]|\{{({NAME}: {SCALAR}(?:, {NAME}: {SCALAR})*+)\}})\n')
SIMPLE = r"[A-Za-z0-9]++(?: [A-Za-z0-9]++)*+"
INLINE = rf"(?=[A-Za-z\[`!])(?:[A-Za-z0-9 ,.]++|`[A-Za-z0-9]++`|!?\[{SIMPLE}\]\([A-Za-z0-9/._~%?#=:+-]++\))++(?<! )\n"
BODY = re.compile(rf"(?:\n|(?:- {INLINE})++(?=\n|\Z)|{INLINE}(?=\n|\Z)|#{{1,6}} {SIMPLE}\n)*+\Z")
LINK, HEADING = re.compile(r"(!?)\[([^\]]*)\]\(([^)]*)\)"), re.compile(r"^(#{1,6}) (.*)$", re.M)


def scalar(text: str) -> tuple[str, str]:
    return ("str", text) if text[0] > "9" and text not in WORDS else yaml.resolve(text, 0)


def front(text: str) -> list[tuple] | None:
    """Entries of a frontmatter text, as yaml.read gives them."""
    if len(text) > LONGEST:
        return None
    rows: list[tuple] = [("", "map", "", None, 0, 0)]
    names: set[str] = set()
    at = end = 0
    while at < len(text):
        m = FIELD.match(text, at)
        if not m or m[1] in names or m[1] in WORDS:
            return None
        name, quoted, plain, listed, mapped = m.groups()
        names.add(name)
        at, end = m.end(), m.end() - 1
        pointer, start = "/" + name, m.start()
        if quoted is not None:
            rows.append((pointer, "str", quoted, None, start, end))
        elif plain is not None:
            rows.append((pointer, *scalar(plain), None, start, end))
        elif listed is not None:
            rows.append((pointer, "seq", "", None, start, end))
            place = m.start(4)
            for k, item in enumerate(listed.split(", ")):
                rows.append((f"{pointer}/{k}", *scalar(item), None, place, place + len(item)))
                place += len(item) + 2
        else:
            rows.append((pointer, "map", "", None, start, end))
            place, inner = m.start(5), set()
            for pair in mapped.split(", "):
                key, value = pair.split(": ", 1)
                if key in inner or key in WORDS:
                    return None
                inner.add(key)
                rows.append((f"{pointer}/{key}", *scalar(value), None, place, place + len(pair)))
                place += len(pair) + 2
    if not names:
        return None
    rows[0] = ("", "map", "", None, 0, end)
    return rows


def body(text: str) -> tuple[list[tuple], list[tuple], list[tuple]] | None:
    """Links, headings and code blocks of a body, as commonmark.read gives them."""
    if len(text) > LONGEST or not BODY.match(text):
        return None
    links = [(m[2], m[3], m.start(), m.end()) for m in LINK.finditer(text) if not m[1]]
    if any(end - start > LONGEST_LINK for _, _, start, end in links):
        return None
    return links, [(len(m[1]), m[2], m.start(), m.end()) for m in HEADING.finditer(text)] if "# " in text else [], []
