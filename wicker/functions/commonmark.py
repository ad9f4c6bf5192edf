"""Markdown to headings, links and code blocks with their places: CommonMark's blocks and inline structure, for use inside Arrow batches.

Blocks are found line by line over a stack of containers (quotes and list items); what holds text is kept with the place
of each of its lines, and read for links once all link definitions are known.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from html.entities import html5

from wicker.functions.yaml import SIGNS, Failure

#: Limits of one document's body (units and bytes, lines, signs, links, definitions, nesting) and of one link (target, label).
MOST_CHARACTERS, MOST_LINES, MOST_SIGNS, MOST_LINKS, MOST_DEFINED, MOST_NESTED, LONGEST_TARGET, LONGEST_LABEL = 262_144, 20_000, 20_000, 5_000, 5_000, 64, 2_048, 512
#: HTML elements that open a block, and those whose text is raw.
BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
OPEN_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*\s*>"
INLINE_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
HTML_STARTS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile(r"<!--"), re.compile(r"-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(rf"</?(?:{BLOCK_TAGS})(?:\s|/?>|$)", re.I), None), (re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})\s*$"), None),
]
PUNCTUATION = "!\"#$%&'()*+,\\-./:;<=>?@[\\]^_`{|}~"
ESCAPED = re.compile(rf"\\([{PUNCTUATION}])|&(?:#[xX]([0-9a-fA-F]{{1,6}})|#([0-9]{{1,7}})|([A-Za-z][A-Za-z0-9]{{1,31}};))(?:(?<=;)|;)")
ATX, SETEXT, RULE, FENCE = re.compile(r"(#{1,6})(?:[ \t]+|$)(.*?)(?:(?:^|[ \t]+)#+)?[ \t]*$"), re.compile(r"(=+|-+)[ \t]*$"), re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"), re.compile(r"(`{3,})[^`]*$|(~{3,})")
ITEM = re.compile(r"([-+*]|(\d{1,9})[.)])(?=[ \t]|$)")
TITLE = r"(?:\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'|\((?:[^()\\]|\\[\s\S])*\))"
LABEL = r"\[((?:[^\\\[\]]|\\[\s\S]){1,999})\]"
BRACKETED = r"<((?:[^<>\n\\]|\\.)*)>"
DEFINED = [re.compile(rf"{LABEL}:[ \t]*\n?[ \t]*(?:{BRACKETED}|([^\s<]\S*)){title}[ \t]*(?:\n|$)") for title in (rf"(?:[ \t]+|[ \t]*\n[ \t]*){TITLE}", "")]
AUTOLINK = re.compile(r"<(?:([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)|([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*))>", re.A)
ORDINARY = re.compile(r"[^\\`<&*_!\[\]\n]+|!(?!\[)")


def unescape(text: str) -> str:
    """Backslash escapes and character references as what they stand for."""

    def one(m: re.Match) -> str:
        if m[1]:
            return m[1]
        if m[4]:
            return html5.get(m[4], m[0])
        code = int(m[2], 16) if m[2] else int(m[3])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"

    return ESCAPED.sub(one, text)


def identifier(label: str) -> str:
    return re.sub(r"\s+", " ", label.strip()).lower()


class Blocks:
    """Headings and paragraphs as (level or 0, [(line, place)]), code blocks, and link definitions of a text with LF line ends."""

    def __init__(self, text: str):
        self.texts: list[tuple[int, list[tuple[str, int]], int, int]] = []
        self.code: list[tuple[int, bool]] = []
        self.defined: dict[str, str] = {}
        self.open: list[tuple] = []
        self.leaf: tuple | None = None
        at = 0
        for line in text.split("\n"):
            self.line(line, at)
            at += len(line) + 1
        self.close()

    def close(self) -> None:
        """End the open leaf; a paragraph gives up the definitions it begins with."""
        leaf, self.leaf = self.leaf, None
        if leaf and leaf[0] == "paragraph":
            lines = self.undefined(leaf[1])
            if lines:
                self.texts.append((0, lines, lines[0][1], lines[-1][1] + len(lines[-1][0])))

    def undefined(self, lines: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """What is left of a paragraph after its leading definitions."""
        while lines and lines[0][0].startswith("["):
            text = "\n".join(x for x, _ in lines)
            m = next((m for m in (d.match(text) for d in DEFINED) if m and m[1].strip()), None)
            if not m:
                break
            if identifier(m[1]) not in self.defined:
                if len(self.defined) >= MOST_DEFINED:
                    raise Failure("too many link definitions", 0, limit=True)
                self.defined[identifier(m[1])] = unescape(m[2] if m[2] is not None else m[3])
            lines = lines[m[0].count("\n") if m[0].endswith("\n") else len(lines) :]
        return lines

    def line(self, line: str, place: int) -> None:
        at, column, matched, owed = 0, 0, 0, 0

        def look() -> tuple[int, int]:
            """Place of the next sign that is no blank, and blanks before it as columns."""
            k, c = at, column
            while k < len(line) and line[k] in " \t":
                c += 4 - c % 4 if line[k] == "\t" else 1
                k += 1
            return k, c - column + owed

        def take(columns: int) -> None:
            """Past so many columns of blanks; of a tab that is cut, the rest is owed."""
            nonlocal at, column, owed
            owed, need = max(owed - columns, 0), max(columns - owed, 0)
            while need > 0 and at < len(line) and line[at] in " \t":
                width = 4 - column % 4 if line[at] == "\t" else 1
                at, column = at + 1, column + width
                owed, need = owed + max(width - need, 0), max(need - width, 0)

        for kind, *rest in self.open:
            k, indent = look()
            if kind == "quote":
                if indent > 3 or line[k : k + 1] != ">":
                    break
                at, column, owed = k + 1, column + indent - owed + 1, 0
                take(1)
            elif k == len(line):
                if rest[1] and self.leaf is None and matched == len(self.open) - 1 and not rest[2]:
                    break
            elif indent >= rest[0]:
                take(rest[0])
            else:
                break
            matched += 1
        whole = matched == len(self.open)
        paragraph = self.leaf is not None and self.leaf[0] == "paragraph"
        if whole and self.leaf and self.leaf[0] in ("fence", "html"):
            return self.raw(line, at, look)
        if not whole and not paragraph:
            self.close()
        opened = False
        while True:
            k, indent = look()
            rest = line[k:]
            if not rest:
                break
            here = whole and paragraph and not opened
            if indent > 3:
                if not (paragraph and not opened):
                    self.cut(matched)
                    if self.leaf is None or self.leaf[0] != "code":
                        self.close()
                        self.leaf = ("code",)
                        self.code.append((place + k, False))
                    return None
                break
            if rest[0] == ">":
                matched = self.begin(matched, ("quote",))
                at, column, owed = k + 1, column + indent - owed + 1, 0
                take(1)
            elif m := ATX.match(rest):
                self.cut(matched)
                begin = k + m.start(2)
                self.texts.append((len(m[1]), [(m[2], place + begin)], place + k, place + len(line.rstrip())))
                return None
            elif m := FENCE.match(rest):
                self.cut(matched)
                self.leaf = ("fence", rest[0], len(m[1] or m[2]))
                self.code.append((place + k, True))
                return None
            elif rest[0] == "<" and (start := next((n for n, (s, _) in enumerate(HTML_STARTS) if s.match(rest) and (n < 6 or not (paragraph and not opened))), None)) is not None:
                self.cut(matched)
                end = HTML_STARTS[start][1]
                self.leaf = None if end and end.search(rest) else ("html", end)
                return None
            elif here and SETEXT.match(rest) and (left := self.undefined(self.leaf[1])):
                self.leaf = None
                self.texts.append((1 if rest[0] == "=" else 2, left, left[0][1], place + len(line.rstrip())))
                return None
            elif RULE.match(rest):
                self.cut(matched)
                return None
            elif (m := ITEM.match(rest)) and not (here and (not rest[m.end() :].strip() or m[2] not in (None, "1") and int(m[2]) != 1)):
                at, column, owed = k + m.end(), column + indent - owed + m.end(), 0
                after, blanks = look()
                empty = after == len(line)
                width = 1 if empty or blanks > 4 else blanks
                matched = self.begin(matched, ("item", indent + m.end() + width, empty, []))
                take(width)
            else:
                break
            opened, whole = True, True
            paragraph = False
            if len(self.open) > MOST_NESTED:
                raise Failure("quotes and lists are nested too deeply", place, limit=True)
        if not rest:
            if self.leaf is None or self.leaf[0] != "code":
                self.close()
            return None
        if self.leaf is not None and self.leaf[0] == "paragraph" and not opened:
            self.leaf[1].append((rest.rstrip() + ("  " if len(rest) - len(rest.rstrip(" ")) >= 2 else ""), place + k))
            return None
        self.cut(matched)
        self.leaf = ("paragraph", [(rest.rstrip() + ("  " if len(rest) - len(rest.rstrip(" ")) >= 2 else ""), place + k)])
        for kind, *of in self.open:
            if kind == "item":
                of[2].append(1)
        return None

    def cut(self, matched: int) -> None:
        """Close what this line does not continue."""
        self.close()
        del self.open[matched:]
        for kind, *of in self.open:
            if kind == "item":
                of[2].append(1)

    def begin(self, matched: int, container: tuple) -> int:
        self.cut(matched)
        self.open.append(container)
        return matched + 1

    def raw(self, line: str, at: int, look) -> None:
        """A line of a fence or an HTML block."""
        k, indent = look()
        if self.leaf[0] == "fence":
            m = re.match(rf"{re.escape(self.leaf[1])}{{{self.leaf[2]},}}[ \t]*$", line[k:])
            if m and indent <= 3:
                self.leaf = None
        elif self.leaf[1].search(line[at:]) if self.leaf[1] else not line[at:].strip():
            self.leaf = None


def flanks(text: str, begin: int, end: int) -> tuple[bool, bool]:
    """Whether a run of * or _ can open and close emphasis."""
    before, after = text[begin - 1] if begin else " ", text[end] if end < len(text) else " "
    blank = lambda c: c.isspace()
    mark = lambda c: unicodedata.category(c)[0] in "PS"
    left = not blank(after) and (not mark(after) or blank(before) or mark(before))
    right = not blank(before) and (not mark(before) or blank(after) or mark(after))
    return (left, right) if text[begin] == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))


def plain(tokens: list) -> str:
    """Text of tokens, with runs that pair up as emphasis taken out. A run is [sign, left over, length, opens, closes]."""
    runs = [t for t in tokens if isinstance(t, list)]
    bottom: dict[tuple, int] = {}
    k = 0
    stack: list[int] = []
    while k < len(runs):
        closer = runs[k]
        key = (closer[0], closer[3], closer[2] % 3)
        found = None
        if closer[4] and closer[1]:
            for j in range(len(stack) - 1, bottom.get(key, 0) - 1, -1):
                opener = runs[stack[j]]
                if opener[0] == closer[0] and opener[1] and not ((opener[4] or closer[3]) and (opener[2] + closer[2]) % 3 == 0 and (opener[2] % 3 or closer[2] % 3)):
                    found = j
                    break
            if found is None:
                bottom[key] = len(stack)
        if found is None:
            if closer[3] and closer[1]:
                stack.append(k)
            k += 1
            continue
        opener = runs[stack[found]]
        used = 2 if opener[1] >= 2 and closer[1] >= 2 else 1
        opener[1] -= used
        closer[1] -= used
        del stack[found + (1 if opener[1] else 0) :]
        bottom = {b: min(n, len(stack)) for b, n in bottom.items()}
        if not closer[1]:
            k += 1
    return "".join(t[0] * t[1] if isinstance(t, list) else t for t in tokens)


def destination(text: str, at: int) -> tuple[str, int] | None:
    """Target of an inline link whose `(` is at `at`, and where its `)` ends."""
    at = re.compile(r"\s*").match(text, at + 1).end()
    target = ""
    if text[at : at + 1] == "<":
        m = re.compile(BRACKETED).match(text, at)
        if not m:
            return None
        target, at = m[1], m.end()
    else:
        deep, begin = 0, at
        while at < len(text) and not text[at].isspace() and text[at] > "\x1f":
            if text[at] == "\\" and at + 1 < len(text):
                at += 1
            elif text[at] == "(":
                deep += 1
            elif text[at] == ")":
                if not deep:
                    break
                deep -= 1
            at += 1
        if deep:
            return None
        target = text[begin:at]
    m = re.compile(rf"(?:\s+{TITLE})?\s*\)").match(text, at)
    return (unescape(target), m.end()) if m else None


def inline(lines: list[tuple[str, int]], defined: dict[str, str], links: list[tuple]) -> str:
    """Plain text of a heading or paragraph; its links (label, target, start, end) are added to links."""
    text = "\n".join(x for x, _ in lines)
    starts = [0]
    for x, _ in lines:
        starts.append(starts[-1] + len(x) + 1)
    where = lambda k: lines[row][1] + k - starts[row] if (row := min(bisect_right(starts, k) - 1, len(lines) - 1)) >= 0 else 0
    if not any(c in text for c in "\\`<&*_[\n"):
        return text.strip()
    tokens: list = []
    brackets: list[list] = []
    at = 0
    ticks: dict[int, int] = {}
    while at < len(text):
        c = text[at]
        if m := ORDINARY.match(text, at):
            tokens.append(m[0])
            at = m.end()
        elif c == "\\":
            follows = text[at + 1 : at + 2]
            tokens.append(" " if follows == "\n" else follows if follows and re.match(rf"[{PUNCTUATION}]", follows) else "\\")
            at += 2 if follows == "\n" or follows and tokens[-1] == follows else 1
        elif c == "\n":
            if tokens and isinstance(tokens[-1], str):
                hard = tokens[-1].endswith("  ")
                tokens[-1] = tokens[-1].rstrip(" ")
            else:
                hard = False
            tokens.append(" " if hard else "\n")
            at += 1
        elif c == "`":
            run = re.compile("`+").match(text, at)
            n = run.end() - at
            end = None
            if ticks.get(n, len(text)) > at:
                end = next((m for m in re.compile("`+").finditer(text, run.end()) if m.end() - m.start() == n), None)
            if end is None:
                ticks[n] = min(ticks.get(n, len(text)), at)
                tokens.append(run[0])
                at = run.end()
            else:
                code = text[run.end() : end.start()].replace("\n", " ")
                tokens.append(code[1:-1] if len(code) > 1 and code[0] == code[-1] == " " and code.strip(" ") else code)
                at = end.end()
        elif c == "<":
            if m := AUTOLINK.match(text, at):
                links.append((m[1] or m[2], m[1] or "mailto:" + m[2], where(at), where(m.end() - 1) + 1))
                tokens.append(m[1] or m[2])
                at = m.end()
            elif m := INLINE_HTML.match(text, at):
                at = m.end()
            else:
                tokens.append(c)
                at += 1
        elif c == "&":
            m = ESCAPED.match(text, at)
            tokens.append(unescape(m[0]) if m else c)
            at = m.end() if m else at + 1
        elif c in "*_":
            end = re.compile(rf"\{c}+").match(text, at).end()
            tokens.append([c, end - at, end - at, *flanks(text, at, end)])
            at = end
        elif c in "![":
            brackets.append([len(tokens), c == "!", True, at, len(links)])
            tokens.append("![" if c == "!" else "[")
            at += 2 if c == "!" else 1
            brackets[-1].append(at)
        else:
            at = closed(text, at, tokens, brackets, links, defined, where)
    return plain(tokens).strip()


def closed(text: str, at: int, tokens: list, brackets: list[list], links: list[tuple], defined: dict[str, str], where) -> int:
    """A closing bracket: a link or image if what opened it may, and a target follows or a definition is named."""
    opener = brackets.pop() if brackets else None
    if opener is None or not opener[2]:
        tokens.append("]")
        return at + 1
    first, image, _, begin, before, inside = opener
    found = destination(text, at + 1) if text[at + 1 : at + 2] == "(" else None
    if found is None:
        named = re.compile(LABEL).match(text, at + 1)
        name, end = (named[1], named.end()) if named and named[1].strip() else (text[inside:at], at + 3 if text[at + 1 : at + 3] == "[]" else at + 1)
        if named and named[1].strip() or at - inside <= 999 and not re.search(r"(?<!\\)(?:\\\\)*[\[\]]", name):
            target = defined.get(identifier(name)) if name.strip() else None
            found = (target, end) if target is not None else None
    if found is None:
        tokens.append("]")
        return at + 1
    label = plain(tokens[first + 1 :])
    del tokens[first:]
    tokens.append(label)
    if image:
        del links[before:]
    else:
        links.append((label.strip(), found[0], where(begin), where(found[1] - 1) + 1))
        for other in brackets:
            other[2] = other[2] and other[1]
    return found[1]


def read(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Links (label, target, start, end), headings (level, text, start, end) and code blocks (start, fenced), each in order of place, of a text with LF line ends; or Failure."""
    units = len(text) + sum(c > "\uffff" for c in text) if not text.isascii() else len(text)
    if units > MOST_CHARACTERS or (not text.isascii() and len(text.encode("utf-8", "surrogatepass")) > MOST_CHARACTERS) or text.count("\n") + (not text.endswith("\n")) > MOST_LINES:
        raise Failure("the body is too long", 0, len(text), limit=True)
    if len(text) > MOST_SIGNS and len(SIGNS.findall(text)) > MOST_SIGNS:
        raise Failure("the body is too complex", 0, len(text), limit=True)
    blocks = Blocks(text)
    links: list[tuple] = []
    headings = []
    for level, lines, start, end in blocks.texts:
        said = inline(lines, blocks.defined, links)
        if level:
            headings.append((level, said, start, end))
    if len(links) > MOST_LINKS or any(len(t.encode("utf-8", "surrogatepass")) > LONGEST_TARGET or len(x.encode("utf-8", "surrogatepass")) > LONGEST_LABEL for x, t, _, _ in links):
        raise Failure("too many links, or one that is too long", 0, len(text), limit=True)
    return sorted(links, key=lambda x: (x[2], x[1], x[0])), sorted(headings, key=lambda h: h[2]), blocks.code
