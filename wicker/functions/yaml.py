"""Frontmatter text to entries: a recursive reader of YAML block and flow nodes, for use inside Arrow batches.

A node is (kind, value, tag, start, end, children); children are (key, node) pairs, keys of sequences their numbers.
flatten() turns the tree into rows (pointer, kind, value, tag, start, end) in document order, aliases expanded. All
meaning of fields is left to Column expressions over these rows.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone

#: Limits of one document's frontmatter (characters and bytes, lines, signs, indentation, nesting, alias expansions, units of output).
MOST_CHARACTERS, MOST_LINES, MOST_SIGNS, MOST_INDENT, MOST_NESTED, MOST_ALIASES, MOST_UNITS = 65_536, 4_000, 8_000, 128, 64, 100, 131_072
#: What plain scalars stand for (core schema), tags that are known, escapes of double quotes.
NULL, BOOL = re.compile(r"~|null|Null|NULL|"), re.compile(r"true|True|TRUE|false|False|FALSE")
INT, FLOAT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+"), re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
ENDLESS = re.compile(r"[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")
STANDARD = "tag:yaml.org,2002:"
TAGS = ("binary", "bool", "float", "int", "map", "null", "omap", "pairs", "seq", "set", "str", "timestamp")
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
STAMP = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d(?:\.\d+)?)(?:[ \t]*(Z|[-+]\d\d?(?::?\d\d)?))?)?")

SIGNS = re.compile(r"[\x01-\x08\x0b\x0c\x0e-\x1f!-/:-@\[-`{-~]")
PROPERTY = re.compile(r"&([^\s,\[\]{}]+)|!<([^>\s]*)>|!(!?)([^\s,\[\]{}]*)")
PLAIN_START = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s])")
PLAIN_START_IN_FLOW = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=[^\s,\[\]{}])")
PLAIN, PLAIN_IN_FLOW = re.compile(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?=[^\s#:]|:\S))+"), re.compile(r"(?:[^\s:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#|[ \t]+(?=[^\s#:,\[\]{}]|:[^\s,\[\]{}]))+")
DOUBLE, SINGLE = re.compile(r'"((?:[^"\\]|\\[\s\S])*)"'), re.compile(r"'((?:[^']|'')*)'")
BLANKS = re.compile(r"(?:[ \t]*(?:(?:(?<=\s)|(?<![\s\S]))#[^\n]*)?\n)*")
BLOCK_HEAD = re.compile(r"[|>](?:([1-9])([+-])?|([+-])([1-9])?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?:\n|$)")
SEPARATED = re.compile(r"[ \t]*(?:(?<=[ \t\n])#[^\n]*)?(?:\n|$)")


class Failure(Exception):
    """What is wrong, where, and whether a limit is why."""

    def __init__(self, message: str, start: int, end: int | None = None, limit: bool = False):
        super().__init__(message)
        self.start, self.end, self.limit = start, start + 1 if end is None else end, limit


def fold(text: str) -> str:
    """Line folding of plain and quoted scalars: a line end is a space, and n blank lines are n line ends."""
    return re.sub(r"[ \t]*\n[ \t]*((?:\n[ \t]*)*)", lambda m: "\n" * m[1].count("\n") or " ", text)


def unescape(text: str, at: int) -> str:
    text = re.sub(r"(\\[\s\S])|[ \t]*\n[ \t]*((?:\n[ \t]*)*)", lambda m: m[1] or ("\n" * m[2].count("\n") or " "), re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", text))

    def one(m: re.Match) -> str:
        if m[1] in ("x", "u", "U"):
            size = {"x": 2, "u": 4, "U": 8}[m[1]]
            digits = text[m.end() : m.end() + size]
            if not re.fullmatch(f"[0-9a-fA-F]{{{size}}}", digits) or int(digits, 16) > 0x10FFFF:
                raise Failure("an escape needs hexadecimal digits of a character", at)
            return "\0" + digits
        if m[1] not in ESCAPES:
            raise Failure(f"no such escape: \\{m[1]}", at)
        return ESCAPES[m[1]]

    # Escapes with digits are put together in a second step, so that surrogate halves can meet.
    out, last = [], 0
    for m in re.finditer(r"\\([\s\S])", text):
        if m.start() < last:
            continue
        out.append(text[last : m.start()])
        piece, last = one(m), m.end()
        if piece[:1] == "\0" and len(piece) > 1:
            out.append(chr(int(piece[1:], 16)))
            last += len(piece) - 1
        else:
            out.append(piece)
    joined = "".join(out) + text[last:]
    return joined.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if re.search("[\ud800-\udfff]", joined) else joined


class Reader:
    def __init__(self, source: str):
        self.s, self.at, self.anchors, self.depth = source, 0, {}, 0

    def fail(self, message: str, at: int | None = None) -> None:
        raise Failure(message, self.at if at is None else at)

    def column(self, at: int) -> int:
        return at - (self.s.rfind("\n", 0, at) + 1)

    def skip(self) -> None:
        """Past blank lines and comments, to the first sign of the next line that says something."""
        self.at = BLANKS.match(self.s, self.at).end()
        m = re.compile(r"[ \t]*(?:#[^\n]*)?$").match(self.s, self.at)
        if m and m.end() == len(self.s):
            self.at = len(self.s)
            return
        indent = re.compile(r" *").match(self.s, self.at).end()
        if self.s[indent : indent + 1] == "\t":
            self.fail("tabs do not indent", indent)
        self.at = indent

    def line_done(self) -> None:
        """After a value: nothing but a comment may follow on the line."""
        m = SEPARATED.match(self.s, self.at)
        if not m:
            self.fail("a value ends before its line does")
        self.at = m.end()

    def document(self) -> tuple:
        self.skip()
        if self.at == len(self.s):
            return ("null", "", None, 0, 0, [])
        node = self.block(-1, self.column(self.at), True)
        self.skip()
        if self.at < len(self.s):
            self.fail("unexpected text after the document, or wrong indentation")
        return node

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MOST_NESTED + 1:
            raise Failure("collections are nested too deeply", self.at, limit=True)

    def block(self, parent: int, column: int, maps: bool) -> tuple:
        """The node that starts here, in lines that are indented more than parent; maps says whether a mapping may begin on this line."""
        tag, anchor, begin = None, None, self.at
        fresh = maps
        while m := PROPERTY.match(self.s, self.at):
            if self.s[m.end() : m.end() + 1] not in ("", " ", "\t", "\n"):
                self.fail("a tag or anchor ends with a blank")
            if m[1] is not None:
                anchor = m[1]
            else:
                tag = m[2] if m[2] is not None else (STANDARD if m[3] else "!") + m[4]
            self.at = re.compile(r"[ \t]*").match(self.s, m.end()).end()
            column = self.column(self.at)
        if self.at > begin and SEPARATED.match(self.s, self.at):
            self.at = SEPARATED.match(self.s, self.at).end()
            self.skip()
            column, fresh = self.column(self.at), True
            if self.at == len(self.s) or not (column > parent or (column == parent and self.dash())):
                return self.named(anchor, self.tagged(("null", "", None, begin, begin, []), tag, begin))
        elif self.at > begin and maps and self.key_ahead():
            # Properties before a key on one line belong to the key, whose text is all that counts.
            tag = anchor = None
            self.at, fresh = begin, True
            column = self.column(begin)
        node = self.tagged(self.value(parent, column, fresh), tag, begin)
        return self.named(anchor, node)

    def named(self, anchor: str | None, node: tuple) -> tuple:
        if anchor is not None:
            self.anchors[anchor] = node
        return node

    def dash(self) -> bool:
        return self.s[self.at : self.at + 1] == "-" and self.s[self.at + 1 : self.at + 2] in ("", " ", "\t", "\n")

    def key_ahead(self) -> bool:
        """The line begins with a key: a scalar on one line, then a colon and a blank or the line's end."""
        at = self.at
        while m := PROPERTY.match(self.s, at):
            at = re.compile(r"[ \t]*").match(self.s, m.end()).end()
        here = self.s[at : at + 1]
        if here == "?" and self.s[at + 1 : at + 2] in ("", " ", "\t", "\n"):
            return True
        m = (DOUBLE if here == '"' else SINGLE).match(self.s, at) if here and here in "\"'" else re.compile(r"\*[^\s,\[\]{}]+[ \t]").match(self.s, at) if here == "*" else PLAIN.match(self.s, at) if PLAIN_START.match(self.s, at) else None
        end = at if here == ":" and not m else m.end() if m else None
        if end is None or "\n" in self.s[at:end]:
            return False
        return bool(re.compile(r"[ \t]*:(?=[ \t\n]|$)").match(self.s, end))

    def value(self, parent: int, column: int, maps: bool) -> tuple:
        here, begin = self.s[self.at : self.at + 1], self.at
        if here == "-" and self.dash():
            if not maps:
                self.fail("a list begins on its own line")
            return self.sequence(column)
        if self.key_ahead():
            if not maps:
                self.fail("a mapping begins on its own line")
            return self.mapping(column)
        if here == "*":
            node = self.alias()
        elif here and here in "[{":
            node = self.flow(parent)
        elif here and here in "|>":
            return self.literal(parent)
        elif here and here in "\"'":
            node = self.quoted(parent)
        else:
            return self.plain(parent, begin)
        self.line_done()
        return node

    def alias(self) -> tuple:
        m = re.compile(r"\*([^\s,\[\]{}]+)").match(self.s, self.at)
        if not m or m[1] not in self.anchors:
            self.fail("an alias needs an anchor before it")
        node, begin = self.anchors[m[1]], self.at
        self.at = m.end()
        return ("alias", m[1], None, begin, m.end(), [("", node)])

    def quoted(self, parent: int) -> tuple:
        begin, double = self.at, self.s[self.at] == '"'
        m = (DOUBLE if double else SINGLE).match(self.s, begin)
        if not m:
            self.fail("a quote is not closed", len(self.s))
        for line in re.finditer(r"\n( *)(?=[^ \n])", m[0]):
            if len(line[1]) <= parent:
                self.fail("a quoted text goes on less indented than its field", begin + line.end())
        self.at = m.end()
        return ("str", unescape(m[1], begin) if double else fold(m[1].replace("''", "'")), None, begin, m.end(), ["quoted"])

    def plain(self, parent: int, begin: int) -> tuple:
        if not PLAIN_START.match(self.s, begin):
            self.fail("no plain text begins with this sign")
        end = self.at = PLAIN.match(self.s, begin).end()
        lines = [self.s[begin:end]]
        while (m := re.compile(r"[ \t]*\n((?:[ \t]*\n)*)( *)(?=[^ \n])").match(self.s, self.at)) and len(m[2]) > parent:
            if self.s[m.end()] == "#" or not (more := PLAIN.match(self.s, m.end())):
                break
            if re.compile(r"[ \t]*:(?=[ \t\n]|$)").match(self.s, more.end()):
                self.fail("a key stands inside a text", m.end())
            lines.append("\n" * m[1].count("\n") or " ")
            lines.append(more[0])
            end = self.at = more.end()
        self.line_done()
        return (*resolve("".join(lines), begin), None, begin, end, [])

    def literal(self, parent: int) -> tuple:
        begin, m = self.at, BLOCK_HEAD.match(self.s, self.at)
        if not m:
            self.fail("a block text's first line holds only signs for it")
        width, chomp, folded = m[1] or m[4], m[2] or m[3] or "", self.s[begin] == ">"
        self.at = m.end()
        indent = max(parent, 0) + int(width) if width else None
        lines: list[str] = []
        while self.at < len(self.s):
            end = self.s.find("\n", self.at)
            line, after = (self.s[self.at : end], end + 1) if end >= 0 else (self.s[self.at :], len(self.s))
            spaces = len(line) - len(line.lstrip(" "))
            if spaces < len(line):
                indent = max(spaces, parent + 1) if indent is None else indent
                if spaces < indent:
                    break
            lines.append(line[indent:] if indent is not None else "")
            self.at = after
        while lines and not lines[-1] and not chomp == "+":
            lines.pop()
        kept = "\n".join(lines) if not folded else folded_lines(lines)
        return ("str", kept + ("\n" if lines and chomp != "-" and any(lines) else ""), None, begin, self.at, ["quoted"])

    def mapping(self, column: int) -> tuple:
        self.deeper()
        begin, pairs, seen = self.at, [], set()
        end = begin
        while True:
            key, key_at, key_end, explicit = self.key(column)
            if key in seen:
                raise Failure("a key stands twice in one mapping", key_at, key_end)
            seen.add(key)
            if explicit is not None:
                node = explicit
            else:
                self.at = re.compile(r"[ \t]*").match(self.s, self.at).end()
                if SEPARATED.match(self.s, self.at):
                    back = self.at
                    self.at = SEPARATED.match(self.s, self.at).end()
                    self.skip()
                    inner = self.column(self.at)
                    if self.at < len(self.s) and (inner > column or (inner == column and self.dash())):
                        node = self.block(column if inner > column else column - 1, inner, True)
                    else:
                        node, end = ("null", "", None, back, back, []), back
                else:
                    node = self.block(column, self.column(self.at), False)
            pairs.append((key, node, key_at))
            end = max(end, node[4])
            self.skip()
            if self.at == len(self.s) or self.column(self.at) < column:
                break
            if self.column(self.at) > column or not self.key_ahead():
                self.fail("a line is no field of its mapping")
        self.depth -= 1
        return ("map", "", None, begin, end, pairs)

    def key(self, column: int) -> tuple[str, int, int, tuple | None]:
        """Text and place of the key here, the colon passed; for `? key`, the value too."""
        explicit = self.s[self.at] == "?" and self.s[self.at + 1 : self.at + 2] in ("", " ", "\t", "\n")
        if explicit:
            self.at = re.compile(r"\?[ \t]*").match(self.s, self.at).end()
            begin = self.at
            node = self.block(column, self.column(begin), True) if not SEPARATED.match(self.s, begin) else ("null", "", None, begin, begin, [])
        else:
            begin = self.at
            tag = None
            while m := PROPERTY.match(self.s, self.at):
                tag = (STANDARD + m[4] if m[3] else m[2]) if m[1] is None else tag
                self.at = re.compile(r"[ \t]*").match(self.s, m.end()).end()
            begin, here = self.at, self.s[self.at]
            if here in "\"'":
                node = self.quoted(-1)
            elif here == "*":
                node = self.alias()
            elif here == ":":
                node = ("null", "", None, begin, begin, [])
            else:
                m = PLAIN.match(self.s, self.at)
                self.at = m.end()
                node = ("str", m[0], None, begin, m.end(), []) if tag == STANDARD + "str" else (*resolve(m[0], begin), None, begin, m.end(), [])
        while node[0] == "alias":
            node = node[5][0][1]
        if node[0] != "str":
            raise Failure("mappings must use text as field names at every level", begin, max(node[4], begin))
        if not explicit:
            self.at = self.s.index(":", self.at) + 1
            return node[1], begin, node[4], None
        self.skip()
        if self.at < len(self.s) and self.column(self.at) == column and self.s[self.at] == ":":
            self.at = re.compile(r":[ \t]*").match(self.s, self.at).end()
            if not SEPARATED.match(self.s, self.at):
                return node[1], begin, node[4], self.block(column, self.column(self.at), True)
        return node[1], begin, node[4], ("null", "", None, begin, begin, [])

    def sequence(self, column: int) -> tuple:
        self.deeper()
        begin, items, end = self.at, [], self.at
        while True:
            start = self.at
            self.at = re.compile(r"-[ \t]*").match(self.s, self.at).end()
            if SEPARATED.match(self.s, self.at):
                self.at = SEPARATED.match(self.s, self.at).end()
                self.skip()
                inner = self.column(self.at)
                node = self.block(column, inner, True) if self.at < len(self.s) and inner > column else ("null", "", None, start + 1, start + 1, [])
            else:
                node = self.block(column, self.column(self.at), True)
            items.append((str(len(items)), node, start))
            end = max(end, node[4])
            self.skip()
            if self.at == len(self.s) or self.column(self.at) != column or not self.dash():
                if self.at < len(self.s) and self.column(self.at) > column:
                    self.fail("a line is no item of its list")
                break
        self.depth -= 1
        return ("seq", "", None, begin, end, items)

    def gap(self, parent: int) -> None:
        """Blanks, comments and line ends inside brackets; lines there are indented more than their field, but for a closing bracket."""
        while True:
            self.at = re.compile(r"[ \t]*").match(self.s, self.at).end()
            if self.s[self.at : self.at + 1] == "#" and self.s[self.at - 1] in " \t\n":
                self.at = self.s.find("\n", self.at) if "\n" in self.s[self.at :] else len(self.s)
            if self.s[self.at : self.at + 1] != "\n":
                break
            self.at += 1
            rest = re.compile(r" *").match(self.s, self.at)
            if rest.end() - rest.start() <= parent and self.s[rest.end() : rest.end() + 1] not in ("", "\n", "#", "]", "}"):
                self.fail("brackets go on less indented than their field", rest.end())
        if self.at == len(self.s):
            self.fail("a bracket is not closed")

    def flow(self, parent: int) -> tuple:
        """A node inside brackets, or the brackets themselves."""
        self.deeper()
        begin, square = self.at, self.s[self.at] == "["
        self.at += 1
        items: list[tuple] = []
        seen: set[str] = set()
        while True:
            self.gap(parent)
            if self.s[self.at] == ("]" if square else "}"):
                break
            key_at = self.at
            explicit = bool(re.compile(r"\?(?=[\s])").match(self.s, self.at))
            if explicit:
                self.at += 1
                self.gap(parent)
            node = self.flow_node(parent)
            self.gap(parent)
            json_like = node[0] in ("map", "seq") or "quoted" in node[5]
            colon = self.s[self.at] == ":" and (json_like or self.s[self.at + 1 : self.at + 2] in ("", " ", "\t", "\n", ",", "[", "]", "{", "}"))
            if colon or explicit or not square:
                name = node
                while name[0] == "alias":
                    name = name[5][0][1]
                if name[0] != "str":
                    raise Failure("mappings must use text as field names at every level", key_at, max(node[4], key_at + 1))
                if square and "\n" in self.s[key_at : self.at]:
                    self.fail("a key in a list stands on one line")
                value = ("null", "", None, node[4], node[4], [])
                if colon:
                    self.at += 1
                    self.gap(parent)
                    if self.s[self.at] not in ",]}":
                        value = self.flow_node(parent)
                        self.gap(parent)
                pair = (name[1], value, key_at)
                if square:
                    items.append((str(len(items)), ("map", "", None, key_at, value[4], [pair]), key_at))
                else:
                    if name[1] in seen:
                        raise Failure("a key stands twice in one mapping", key_at, node[4])
                    seen.add(name[1])
                    items.append(pair)
            else:
                items.append((str(len(items)), node, key_at))
            if self.s[self.at] == ",":
                self.at += 1
            elif self.s[self.at] != ("]" if square else "}"):
                self.fail("items in brackets are parted by commas")
        self.at += 1
        self.depth -= 1
        return ("seq" if square else "map", "", None, begin, self.at, items)

    def flow_node(self, parent: int) -> tuple:
        tag, anchor, begin = None, None, self.at
        while m := PROPERTY.match(self.s, self.at):
            if m[1] is not None:
                anchor = m[1]
            else:
                tag = m[2] if m[2] is not None else (STANDARD if m[3] else "!") + m[4]
            self.at = m.end()
            self.gap(parent)
        here = self.s[self.at]
        if here in "[{":
            node = self.flow(parent)
        elif here in "\"'":
            node = self.quoted(parent)
        elif here == "*":
            node = self.alias()
        elif here in ",]}:" and (tag or anchor or here == ":"):
            node = ("null", "", None, begin, self.at, [])
        else:
            if not PLAIN_START_IN_FLOW.match(self.s, self.at):
                self.fail("no plain text begins with this sign")
            start, parts = self.at, []
            while True:
                m = PLAIN_IN_FLOW.match(self.s, self.at)
                parts.append(m[0])
                self.at = m.end()
                more = re.compile(r"[ \t]*\n((?:[ \t]*\n)*)[ \t]*(?=[^\s#,\[\]{}:])").match(self.s, self.at)
                if not more or self.column(more.end()) <= parent:
                    break
                parts.append("\n" * more[1].count("\n") or " ")
                self.at = more.end()
            node = (*resolve("".join(parts), start), None, start, self.at, [])
        return self.named(anchor, self.tagged(node, tag, begin))

    def tagged(self, node: tuple, tag: str | None, at: int) -> tuple:
        """The node under an explicit tag; only standard ones are known."""
        if tag is None or node[0] == "alias":
            return node
        kind, _, _, start, end, children = node
        name = tag.removeprefix(STANDARD)
        if tag == "!":
            return ("str", self.raw(node), None, start, end, []) if kind not in ("map", "seq") else node
        if name not in TAGS or name == tag:
            raise Failure(f"custom tag is not supported: {tag}", at)
        raw = self.raw(node)
        if name in ("map", "seq", "set", "omap", "pairs"):
            if kind == "null" and start == end:
                kind, children = ("map" if name in ("map", "set") else "seq"), []
            if kind != ("map" if name in ("map", "set") else "seq"):
                raise Failure(f"the tag {name} does not fit its value", at)
            if name == "set":
                if any(child[1][0] != "null" for child in children):
                    raise Failure("entries of a set have no values", at)
                children = [(str(k), ("str", child[0], None, child[2], child[2] + len(child[0]), []), child[2]) for k, child in enumerate(children)]
            if name in ("omap", "pairs") and any(child[1][0] != "map" or len(child[1][5]) != 1 for child in children):
                raise Failure(f"entries of {name} are mappings of one field", at)
            return ("map" if name == "map" else "seq", "", tag, start, end, children)
        if kind in ("map", "seq"):
            raise Failure(f"the tag {name} does not fit its value", at)
        fits = {"str": True, "null": NULL.fullmatch(raw), "bool": BOOL.fullmatch(raw), "int": INT.fullmatch(raw), "float": FLOAT.fullmatch(raw) or ENDLESS.fullmatch(raw), "timestamp": STAMP.fullmatch(raw), "binary": re.fullmatch(r"[A-Za-z0-9+/=\s]*", raw)}[name]
        if not fits:
            raise Failure(f"the tag {name} does not fit its value", at)
        if name == "timestamp":
            return ("str", iso(STAMP.fullmatch(raw), at), tag, start, end, [])
        if name in ("str", "binary"):
            return (name, raw, tag, start, end, [])
        return ("float" if name == "float" else resolve(raw, at)[0] if name != "null" else "null", raw if name == "float" else resolve(raw, at)[1], tag, start, end, [])

    def raw(self, node: tuple) -> str:
        return node[1] if node[0] == "str" or node[5] else "" if node[3] == node[4] else fold(self.s[node[3] : node[4]])


def folded_lines(lines: list[str]) -> str:
    """Folding of block texts: between two lines at the text's own indentation a line end is a space; more indented lines and blank ones keep theirs."""
    out, held = "", 0
    plain = True
    for k, line in enumerate(lines):
        if not line:
            held += 1
            continue
        flush = not line[0] in " \t"
        if k == held and not out:
            out = "\n" * held + line
        elif plain and flush:
            out += ("\n" * held or " ") + line
        else:
            out += "\n" * (held + 1) + line
        plain, held = flush, 0
    return out + "\n" * held


def iso(m: re.Match, at: int) -> str:
    try:
        seconds = float(m[6] or 0)
        zone = m[7] or "Z"
        hours, minutes = (0, 0) if zone == "Z" else (int(zone[1:].split(":")[0][:2]), int(zone.replace(":", "")[3:] or 0))
        offset = timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
        when = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), tzinfo=timezone(offset)) + timedelta(milliseconds=int(seconds * 1000))
    except ValueError as error:
        raise Failure("no such time", at) from error
    return when.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"


def resolve(text: str, at: int) -> tuple[str, str]:
    """Kind and value of a plain scalar."""
    if NULL.fullmatch(text):
        return "null", ""
    if BOOL.fullmatch(text):
        return "bool", text.lower()
    if INT.fullmatch(text):
        return "int", str(int(text[2:], 8 if text[1] == "o" else 16) if text[:2] in ("0o", "0x") else int(text) if len(text) < 4000 else text)
    if FLOAT.fullmatch(text):
        return "float", text
    return ("endless" if ENDLESS.fullmatch(text) else "str"), text


def check(source: str) -> None:
    """Limits on the text, before it is read."""
    lines = source.split("\n")
    if len(source) + sum(c > "\uffff" for c in source) > MOST_CHARACTERS or len(source.encode("utf-8", "surrogatepass")) > MOST_CHARACTERS or len(lines) - source.endswith("\n") > MOST_LINES:
        raise Failure("the frontmatter is too long", 0, len(source), limit=True)
    if len(SIGNS.findall(source)) > MOST_SIGNS or any(len(x) - len(x.lstrip(" ")) > MOST_INDENT for x in lines if len(x) > MOST_INDENT):
        raise Failure("the frontmatter is too complex", 0, len(source), limit=True)


def flatten(root: tuple) -> list[tuple]:
    """Rows (pointer, kind, value, tag, start, end) in document order; the first is the root ''. What aliases stand for is copied; start is a field's key."""
    rows: list[tuple] = []
    units, aliases = 0, 0

    def visit(node: tuple, pointer: str, start: int, above: tuple) -> None:
        nonlocal units, aliases
        end = node[4]
        while node[0] == "alias":
            aliases, units, end = aliases + 1, units + 1, max(end, node[4])
            if aliases > MOST_ALIASES:
                raise Failure(f"more than {MOST_ALIASES} alias expansions are not supported", 0, limit=False)
            node = node[5][0][1]
        if any(node is x for x in above):
            raise Failure("recursive aliases are not supported", 0)
        kind, value, tag, _, _, children = node
        if kind == "endless":
            raise Failure("non-finite numbers are not supported", start, end)
        units += 2 + len(value.encode("utf-8", "surrogatepass")) + (3 + len(tag) if tag else 0)
        rows.append((pointer, kind, value, tag, start, end))
        for child in children if kind in ("map", "seq") else ():
            units += 1 + (len(child[0].encode("utf-8", "surrogatepass")) if kind == "map" else 0)
            if units > MOST_UNITS:
                raise Failure("the frontmatter stands for too much output", 0, limit=True)
            visit(child[1], pointer + "/" + child[0].replace("~", "~0").replace("/", "~1"), child[2], (*above, node))

    visit(root, "", root[3], ())
    return rows


def read(source: str) -> list[tuple]:
    """Entries of a frontmatter text (line ends LF), or Failure. The root must be a mapping."""
    check(source)
    reader = Reader(source)
    root = reader.document()
    if root[0] != "map":
        raise Failure("the frontmatter must be a mapping with text as field names", 0, len(source))
    return flatten(root)
