"""Bundle paths and link targets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wicker.functions.text import has_control, let


def _fold(path: Column) -> Column:
    """Segments with `.` and empty ones gone and `..` applied; null once a `..` leaves the root."""
    start = F.array().cast("array<string>")
    return F.aggregate(
        F.split(path, "/"), start,
        lambda done, s: F.when(done.isNull() | s.isin("", "."), done)
        .when((s == "..") & (F.size(done) == 0), F.lit(None).cast("array<string>"))
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, s)),
    )


def canonical_path(raw: Column) -> Column:
    """The canonical bundle path, or null: no drive, no leading slash, no control character, no escape, 64 segments at most."""
    def checked(path: Column) -> Column:
        refused = path.startswith("/") | path.rlike("^[A-Za-z]:") | has_control(path) | (F.octet_length(path) > 4096)
        return let(_fold(path), lambda done: F.when(~refused & (F.size(done) > 0) & (F.size(done) <= 64), F.array_join(done, "/")))

    return let(F.replace(raw, F.lit("\\"), F.lit("/")), checked)


def concept_id(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def directory_name(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def reserved_kind(path: Column) -> Column:
    """index or log by base name, at any depth; else null."""
    return F.when(base_name(path) == "index.md", "index").when(base_name(path) == "log.md", "log")


def directories_of(path: Column) -> Column:
    """All directories that hold the document, the root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def encode_segment(c: Column) -> Column:
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def split_target(raw: Column) -> Column:
    """struct(path, query, fragment): cut at the first #, then at the first ? before it. Absent parts are null."""
    hash_at, before = F.instr(raw, "#"), F.substring_index(raw, "#", 1)
    fragment = F.when(hash_at > 0, F.substring(raw, hash_at + 1, F.length(raw)))
    mark = F.instr(before, "?")
    return F.struct(F.substring_index(before, "?", 1).alias("path"), F.when(mark > 0, F.substring(before, mark + 1, F.length(before))).alias("query"), fragment.alias("fragment"))


def decoded(path: Column) -> Column:
    """Percent-decoded once; null where an escape is malformed, is no UTF-8 or gives a control character. A decoded backslash separates."""
    def checked(plain: Column) -> Column:
        broken = path.rlike("%(?![0-9A-Fa-f]{2})") | (plain.contains("\ufffd") & ~path.rlike("(?i)\ufffd|%ef%bf%bd")) | has_control(plain)
        return F.when(~broken, F.replace(plain, F.lit("\\"), F.lit("/")))

    return let(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), checked)


def target_parts(raw: Column, source_path: Column) -> Column:
    """What a link target says by itself: struct(kind, resolved, query, fragment, ends_with_slash). kind is null where the bundle's inventory decides."""
    folder = directory_name(source_path)

    def answer(t: Column, plain: Column, done: Column) -> Column:
        path = t["path"]
        kind = (
            F.when((F.length(raw) == 0) | has_control(raw), "invalid")
            .when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | path.startswith("//"), "external")
            .when(path == "", F.when(t["fragment"].isNotNull() & t["query"].isNull(), "fragment").otherwise("invalid"))
            .when(path.contains("\\") | plain.isNull(), "invalid")
            .when(done.isNull(), "out-of-bundle")
        )
        return F.struct(kind.alias("kind"), F.array_join(done, "/").alias("resolved"), t["query"].alias("query"), t["fragment"].alias("fragment"), F.coalesce(plain.endswith("/"), F.lit(False)).alias("ends_with_slash"))

    def placed(t: Column, plain: Column) -> Column:
        rooted = t["path"].startswith("/") | plain.startswith("/")
        full = let(folder, lambda f: F.when(rooted | (f == ""), plain).otherwise(F.concat(f, F.lit("/"), plain)))
        return let(_fold(full), lambda done: answer(t, plain, done))

    return let(split_target(raw), lambda t: let(decoded(t["path"]), lambda plain: placed(t, plain)))


def folder_of(node_id: Column) -> Column:
    return directory_name(node_id)


def in_folder(node_id: Column, folder: str) -> Column:
    return ~node_id.contains("/") if folder == "" else node_id.startswith(folder + "/")


def portable_segment(c: Column) -> Column:
    """Not empty, no reserved sign, no trailing dot or space, no device name (with or without an ending)."""
    return ~(c.rlike(r'[<>:"/\\|?*\x00-\x1f]') | c.rlike(r"[. ]$") | (c == "") | c.rlike(r"(?i)^(con|prn|aux|nul|conin\$|conout\$|(com|lpt)[1-9¹²³]) *(\.|$)"))


#: Fixed value: rounds in which a path may still change when its escapes are decoded.
DECODE_ROUNDS = 16


def stable_decoded(path: Column) -> Column:
    """Percent-decoded until nothing changes; null where an escape is malformed, a control character turns up, or there are too many layers."""
    once = lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    broken = lambda p, q: p.rlike("%(?![0-9A-Fa-f]{2})") | has_control(p) | (q.contains("\ufffd") & ~p.rlike("(?i)\ufffd|%ef%bf%bd"))
    start = F.struct(path.alias("now"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        now = state["now"]
        return let(once(now), lambda q: F.when(state["done"] | now.isNull(), state).when(F.coalesce(broken(now, q), F.lit(True)), F.struct(F.lit(None).cast("string").alias("now"), F.lit(True).alias("done"))).otherwise(F.struct(q.alias("now"), (q == now).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DECODE_ROUNDS)), start, step, lambda s: F.when(s["done"], s["now"]))


def uri_parts(uri: Column) -> Column:
    """struct(scheme, authority, path, query, fragment) of a URI; scheme and authority in lower case, path without a trailing slash (the root is /)."""
    pick = lambda k: F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", k)
    path = let(F.regexp_replace(pick(3), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    return F.struct(F.lower(pick(1)).alias("scheme"), F.lower(pick(2)).alias("authority"), path.alias("path"), pick(4).alias("query"), pick(5).alias("fragment"))


def contained(root: Column, uri: Column) -> Column:
    """The URI is the root or lies below it: same scheme, authority, query and fragment, and a path of whole segments below the root's."""

    def below(r: Column, u: Column) -> Column:
        same = (r["scheme"] != "") & (r["scheme"] == u["scheme"]) & (r["authority"] == u["authority"]) & (r["query"] == u["query"]) & (r["fragment"] == u["fragment"])
        return same & ((r["path"] == "/") | (u["path"] == r["path"]) | F.startswith(u["path"], F.concat(r["path"], F.lit("/"))))

    return let(uri_parts(root), lambda r: let(uri_parts(uri), lambda u: below(r, u)))


def within(root: Column, uri: Column) -> Column:
    """The URI's path relative to a root that contains it, '.' for the root itself; null outside, and for paths that are not canonical."""

    def relative(r: Column, u: Column) -> Column:
        skip = F.when(r["path"] == "/", 2).otherwise(F.length(r["path"]) + 2)
        return F.when(u["path"] == r["path"], F.lit(".")).otherwise(F.substring(u["path"], skip, F.length(u["path"])))

    inner = let(uri_parts(root), lambda r: let(uri_parts(uri), lambda u: relative(r, u)))
    return F.when(contained(root, uri), let(inner, lambda p: F.when((p == ".") | (canonical_path(p) == p), p)))
