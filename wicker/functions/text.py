"""Text helpers as Column expressions: trimming, identity order, quoting, hashing, labels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the white space that trimming removes (ECMAScript's set), as a regular expression class.
SPACE = "[\\s\\x{00a0}\\x{feff}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Colours of concept types, picked by hash.
TYPE_COLORS = ("#4c78a8", "#f58518", "#e45756", "#72b7b2", "#54a24b", "#eeca3b", "#b279a2", "#ff9da6", "#9d755d", "#bab0ac")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def wide_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(wide_trim(c)) > 0, F.lit(False))


def one_line(c: Column) -> Column:
    """Line ends and runs of white space become one space; ends trimmed."""
    return wide_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def escape_label(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[\]])", r"\\$1")


def fallback_title(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.md$", "")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_key(c: Column) -> Column:
    """Sort key for order by UTF-16 code unit, which is not the order of code points beyond U+FFFF."""
    return F.encode(c, "UTF-16BE")


def json_quote(c: Column) -> Column:
    """A text as a JSON string; escapes of control characters have lower-case digits, for which Spark's own are put right."""
    wrapped = F.to_json(F.struct(c.alias("a")))
    out = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    escape = r"(?<!\\)((?:\\\\)*)\\u00"
    low = out
    for digits in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        low = F.regexp_replace(low, escape + digits, r"$1\\u00" + digits.lower())
    return F.when(c.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]"), low).otherwise(out)


def utf16_cut(c: Column, at: Column) -> tuple[Column, Column]:
    """What stands before a place in UTF-16 units, and what stands from there on."""
    raw = F.encode(c, "UTF-16BE")
    return F.decode(F.substring(raw, F.lit(1), at * 2), "UTF-16BE"), F.decode(F.substring(raw, at * 2 + 1, F.octet_length(raw)), "UTF-16BE")


def bounded(c: Column, units: int = 160) -> Column:
    """At most `units` UTF-16 units, the last an ellipsis where text was cut; never half a surrogate pair."""
    raw = F.encode(c, "UTF-16BE")
    last = F.hex(F.substring(raw, F.lit(2 * (units - 2) + 1), F.lit(1)))
    end = F.when(last.between("D8", "DB"), units - 2).otherwise(units - 1)
    return F.when(utf16_length(c) <= units, c).otherwise(F.concat(F.decode(F.substring(raw, F.lit(1), end * 2), "UTF-16BE"), F.lit("…")))


def display_text(c: Column, points: int = 160) -> Column:
    return F.when(F.length(c) > points, F.concat(F.substring(c, 1, points - 1), F.lit("…"))).otherwise(c)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-8 bytes, as a long."""
    code = F.hex(F.encode(c, "UTF-8"))
    count = (F.length(code) / 2).cast("int")
    octets = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(octets, F.lit(0x811C9DC5).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def color_for_type(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPE_COLORS)), (fnv1a(c) % len(TYPE_COLORS)).cast("int") + 1)


def base36(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 36))


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def fallback_hash(c: Column) -> Column:
    return F.concat(F.lit("fnv1a32:"), F.lower(F.lpad(F.hex(fnv1a(c)), 8, "0")))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "concept").otherwise(s)


def label_identifier(c: Column) -> Column:
    """Identifier of a link label: trimmed, white space collapsed, lower case."""
    return F.lower(one_line(c))


def line_ending(c: Column) -> Column:
    return F.when(c.contains("\r\n"), "\r\n").when(c.contains("\r") & ~c.contains("\n"), "\r").otherwise("\n")


def inline_code(c: Column) -> Column:
    """The text between backtick runs one longer than any run in it."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)")), lambda x: F.length(x)))
    fence = F.repeat(F.lit("`"), F.coalesce(longest, F.lit(0)) + 1)
    pad = F.when(c.startswith("`") | c.endswith("`"), " ").otherwise("")
    return F.concat(fence, pad, c, pad, fence)


def has_control(c: Column) -> Column:
    return c.rlike("[\\x00-\\x1f\\x7f]")


def display_type(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "Missing type").otherwise(c)


@F.pandas_udf(T.StringType())
def search_form(s: pd.Series) -> pd.Series:
    """NFKC, then lower case: the form that search terms and values are compared in."""
    return s.str.normalize("NFKC").str.lower()


def actor_ok(c: Column) -> Column:
    """human:<id>, process:<id> or <producer>/<version>, at most 256 characters."""
    token = "[A-Za-z0-9._@:/-]+"
    return F.coalesce((F.length(c) <= 256) & (c.rlike(f"^(human|process):{token}$") | (c.rlike("^[A-Za-z0-9._@:-]+/[A-Za-z0-9._@:-]+$") & ~c.rlike("^(human|process):"))), F.lit(False))


def source_author_ok(c: Column) -> Column:
    return actor_ok(c) | F.coalesce((F.length(c) <= 256) & c.rlike("^team:[A-Za-z0-9._/@:-]+$"), F.lit(False))


def failure_detail(c: Column) -> Column:
    """A failure's message at the length that is kept of it."""
    return bounded(c, 4096)


def title_input(c: Column) -> Column:
    """A title as it was typed: one line, white space collapsed."""
    return one_line(c)


def description_input(c: Column) -> Column:
    """A description as it was typed, its line ends LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def tags_input(c: Column) -> Column:
    """Tags typed with commas between: each trimmed, empty ones left out, repeated ones kept."""
    return F.filter(F.transform(F.split(c, ","), wide_trim), lambda t: t != "")


def with_line_ends(c: Column, newline: Column | str) -> Column:
    """All line ends as the given one."""
    return F.replace(F.regexp_replace(c, "\r\n?", "\n"), F.lit("\n"), F.lit(newline) if isinstance(newline, str) else newline)
