"""Index plans in pieces, managed regions, root versions, and migrations."""

import pytest
from pyspark.sql import functions as F

from wicker.operators import parse, rules
from wicker.plans import indexes, migration

CONCEPT = "---\ntype: note\ntitle: T\ndescription: D\n---\n\n"
ROOT = '---\nokf_version: "0.2"\n---\n'


def parsed_of(spark, files):
    rows = [(b, f"mem://{b}/{p}", p, c if isinstance(c, bytes) else c.encode()) for (b, p), c in ((k if isinstance(k, tuple) else ("b", k), c) for k, c in files.items())]
    return parse.parse(spark.createDataFrame(rows, "bundle_id string, uri string, bundle_path string, content binary")).persist()


def planned(spark, files, lines=2, **options):
    """Operations and whole texts by path; by (bundle, path) where files are."""
    parsed = parsed_of(spark, files)
    chunks = indexes.chunked(parsed, lines).persist()
    rows = indexes.plan(parsed, chunks=chunks, **options).persist()
    many = any(isinstance(k, tuple) for k in files)
    name = lambda r: (r["bundle_id"], r["path"]) if many else r["path"]
    return {name(r): (r["operation"], r["problem"]) for r in rows.collect()}, {name(r): r["text"] for r in indexes.texts(indexes.pieces(rows, chunks)).collect()}


def region(*lines, eol="\n"):
    return eol.join([indexes.START, "## Contents", "", *lines, indexes.END, ""])


def test_directories_of_any_size_keep_their_entries(spark):
    files = {"index.md": ROOT} | {f"d/{k:02}.md": CONCEPT.replace("title: T", f"title: '{k} [y]'") for k in range(7)} | {"d/e/x.md": CONCEPT}
    states, texts = planned(spark, files, 2)
    assert states == {"index.md": ("update", None), "d/index.md": ("create", None), "d/e/index.md": ("create", None)}
    assert texts["d/index.md"] == region(*[f"- [{k} \\[y\\]](./{k:02}.md) - D" for k in range(7)], "- [e](./e/)") and texts["index.md"] == ROOT + "\n" + region("- [d](./d/)")
    again, nothing = planned(spark, files | texts, 3)
    assert {s for s, _ in again.values()} == {"keep"} and nothing == {}


def test_regions_keep_line_ends_and_all_around(spark):
    start, end = indexes.START, indexes.END
    olds, news = {}, {}
    for b, eol in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r")):
        line = "- [T](./x.md) - D"
        cases = {
            "a": (f"# A{eol}{eol}{start}{eol}old{eol}{end}{eol}Tail", f"# A{eol}{eol}{region(line, eol=eol)}Tail"), "b": ("\ufeff" + f"{start}{eol}{end}", "\ufeff" + region(line, eol=eol)), "c": (f"# C{eol}", f"# C{eol}{eol}{region(line, eol=eol)}"),
            "d": (f"x{eol}{eol}", f"x{eol}{eol}{region(line, eol=eol)}"), "e": ("", region(line)), "f": (f"a {start}{eol}b{eol}{start}{eol}{end} c{eol}{end}{eol}", f"a {start}{eol}b{eol}{region(line, eol=eol)}"),
        }
        olds |= {(b, "index.md"): ROOT} | {(b, f"{d}/x.md"): CONCEPT for d in cases} | {(b, f"{d}/index.md"): old for d, (old, _) in cases.items()}
        news |= {(b, f"{d}/index.md"): new for d, (_, new) in cases.items()}
    states, texts = planned(spark, olds)
    assert {k: texts[k] for k in news} == news and all(states[k] == ("update", None) for k in news)
    again, _ = planned(spark, olds | texts)
    assert {s for s, _ in again.values()} == {"keep"}
    missing, texts = planned(spark, olds, missing_only=True)
    assert {s for s, _ in missing.values()} == {"keep"} and texts == {}


def test_refused_regions(spark):
    start, end = indexes.START, indexes.END
    cases = {"a": (f"{start}\n", "incomplete"), "b": (f"{end}\n", "incomplete"), "c": (f"{start}\n{end}\n{start}\n{end}\n", "duplicate"), "d": (f"{end}\n{start}\n", "reversed"), "e": (f"{start}\n{start}\n{end}\n", "duplicate")}
    files = {"index.md": ROOT} | {f"{d}/index.md": text for d, (text, _) in cases.items()}
    states, texts = planned(spark, files)
    assert {d: states[f"{d}/index.md"] for d in cases} == {d: ("refuse", f"managed-region-{why}-markers") for d, (_, why) in cases.items()} and set(texts) == {"index.md"}
    parsed = parsed_of(spark, files)
    assert [r["bundle_id"] for r in indexes.refused(indexes.plan(parsed)).collect()] == ["b"]


ROOTS = [
    ("# Body\r\n", '---\r\nokf_version: "0.2"\r\n---\r\n# Body\r\n'), ("﻿# Body", '﻿---\nokf_version: "0.2"\n---\n# Body'), ("---\n# note\ntitle: \"😀\"\n---\n# B", '---\n# note\nokf_version: "0.2"\ntitle: "😀"\n---\n# B'),
    ("---\n{ title: K }\n---\n# B", '---\n{okf_version: "0.2", title: K }\n---\n# B'), ("---\n{ # kept\n title: K}\n---\n", '---\n{okf_version: "0.2", # kept\n title: K}\n---\n'), ("---\n{}\n---\n", '---\n{okf_version: "0.2"}\n---\n'),
    ("---\n&root\ntitle: K\n---\n# B", '---\n&root\nokf_version: "0.2"\ntitle: K\n---\n# B'), ("---\n  title: K\n---\n", '---\n  okf_version: "0.2"\n  title: K\n---\n'), ("﻿---\r\n# c\r\ntitle: K\r\n---\r\n# B", '﻿---\r\n# c\r\nokf_version: "0.2"\r\ntitle: K\r\n---\r\n# B'),
    ("---\rtitle: K\r---\rB", '---\rokf_version: "0.2"\rtitle: K\r---\rB'), ("---\n# 😀 before\ntitle: K\n---\n", '---\n# 😀 before\nokf_version: "0.2"\ntitle: K\n---\n'), ('---\nokf_version: "0.1"\n---\n', None), ("---\ntitle: [open\n---\n", "refused"), ("---\n- a\n---\n", "refused"),
]


def test_root_versions(spark):
    states, texts = planned(spark, {(str(k), "index.md"): old for k, (old, _) in enumerate(ROOTS)}, missing_only=True)
    for k, (_, new) in enumerate(ROOTS):
        name = (str(k), "index.md")
        assert (states[name], texts.get(name)) == ((("refuse", "root-version-synthesis-refused"), None) if new == "refused" else (("keep" if new is None else "update", None), new))
    assert planned(spark, texts, missing_only=True)[1] == {}


def moved(spark, files, actor="process:migrate"):
    return {r["path"]: r for r in migration.plan(parsed_of(spark, files), actor).collect()}


OLD = '---\nokf_version: "0.1" # v\n---\n'


def test_migration_moves_fields_and_is_done_once(spark):
    files = {"index.md": OLD, "a.md": "﻿---\r\ntype: x\r\n'timestamp' : 2026-07-01T00:00:00Z # when\r\n---\r\n# Citations\r\n\r\n- https://a.test/x\r\n* https://b.test\r\n- https://a.test/x\r\n", "b.md": "---\ntype: x\ntimestamp: 2026-02-31T00:00:00Z\n---\n# Citations\n\n- see https://a.test\n- https://b.test\n"}
    got = moved(spark, files)
    assert got["index.md"]["text"] == '---\nokf_version: "0.2" # v\n---\n'
    assert got["a.md"]["text"] == '﻿---\r\ntype: x\r\ngenerated:\r\n  by: "process:migrate"\r\n  at: "2026-07-01T00:00:00Z" # when\r\nsources:\r\n  - resource: "https://a.test/x"\r\n  - resource: "https://b.test"\r\n---\r\n# Citations\r\n\r\n- https://a.test/x\r\n* https://b.test\r\n- https://a.test/x\r\n'
    assert got["a.md"]["actions"] == [migration.STAMPED, migration.SOURCED] and got["a.md"]["candidates"] == ["https://a.test/x", "https://b.test"] and not got["a.md"]["manual"]
    assert got["b.md"]["reasons"] == [migration.BY_HAND, migration.REVIEW] and got["b.md"]["text"] is None
    done = {p: r["text"] or files[p] for p, r in got.items()}
    parsed = parsed_of(spark, done)
    assert {r["path"] for r in migration.plan(parsed, "process:migrate").where("changed").collect()} == set()
    assert rules.generated(parsed, 1784721600).unionByName(rules.provenance(parsed)).where(F.col("uri").endswith("/a.md")).count() == 0
    with pytest.raises(ValueError, match="actor"):
        migration.plan(parsed, "nobody")


@pytest.mark.parametrize(
    ("body", "urls", "review"),
    [
        ("```\n# Citations\n- https://a.test\n```\n", [], False), ("# Citations\n- https://a.test\n# Next\n- https://b.test\n# Citations #\n- https://c.test\n", ["https://a.test", "https://c.test"], False), ("# Citations\n+ https://a.test\n", [], True), ("# Citations\n- https://a.test\nplain text\n", ["https://a.test"], True),
        ("    # Citations\n    - https://a.test\n", [], False), ("# Citations#\n- https://a.test\n", [], False), ("<div>\n# Citations\n- https://a.test\n</div>\n", [], True), ("# Citations\n~~~\n- https://a.test\n~~~\n", [], True), ("# Citations\n\n", [], True), ("# Citations\n- https://a.test/﻿x\n", [], True),
        ("<!--\n# Citations\n-->\n# Citations\n- https://a.test\n", ["https://a.test"], True), ("## Citations\n- https://a.test\n", [], False), ("# Citations\n<!-- note -->\n- https://a.test\n", ["https://a.test"], True),
    ],
)
def test_citations(body, urls, review):
    found, unclear, got = migration.cited(body)
    assert got == urls and (found and (unclear or not got)) == review


def test_migration_leaves_what_is_unclear(spark):
    files = {"index.md": '---\n"okf_version": \'0.1\'\n---\n'}
    stamps = {"anchor": "timestamp: &t 2026-07-01T00:00:00Z", "folded": "timestamp: >-\n  2026-07-01T00:00:00Z", "tagged": "timestamp: !!str 2026-07-01T00:00:00Z", "quoted": '"timestamp": "2026-07-01T00:00:00Z"', "made": "timestamp: 2026-07-01T00:00:00Z\ngenerated: {by: tool/1}", "next": "timestamp:\n  2026-07-01T00:00:00Z"}
    files |= {f"{k}.md": f"---\ntype: x\n{v}\n---\n" for k, v in stamps.items()}
    files["sourced.md"] = "---\ntype: x\nsources: []\n---\n# Citations\n- https://a.test\n"
    # Listing these would put the frontmatter beyond its limit.
    files["long.md"] = "---\ntype: x\ntimestamp: 2026-07-01T00:00:00Z\nnote: " + "n" * 65_000 + "\n---\n# Citations\n" + "".join(f"- https://a.test/{k}\n" for k in range(40))
    got = moved(spark, files)
    assert {k: (got[f"{k}.md"]["actions"], got[f"{k}.md"]["reasons"]) for k in stamps} == {k: ([], []) if k == "made" else ([migration.STAMPED], []) if k in ("tagged", "quoted") else ([], [migration.BY_HAND]) for k in stamps}
    assert got["sourced.md"]["candidates"] == ["https://a.test"] and not got["sourced.md"]["changed"] and not got["sourced.md"]["manual"]
    assert (got["long.md"]["actions"], got["long.md"]["reasons"]) == ([migration.STAMPED], [migration.REVIEW]) and "generated:" in got["long.md"]["text"] and "sources:" not in got["long.md"]["text"]
    assert got["index.md"]["text"] == '---\nokf_version: "0.2"\n---\n'


def test_bundles_that_do_not_migrate(spark):
    good = {"index.md": OLD, "a.md": "---\ntype: x\n---\n"}
    bundles = {"fine": good, "broken": good | {"b.md": "no frontmatter"}, "rootless": {"a.md": good["a.md"]}, "mute": good | {"index.md": "# I\n"}, "other": good | {"index.md": '---\nokf_version: "0.3"\n---\n'}, "anchored": good | {"index.md": '---\nokf_version: &v "0.1"\n---\n'}, "bytes": good | {"c.md": b"---\n\xff"}}
    parsed = parsed_of(spark, {(b, p): c for b, files in bundles.items() for p, c in files.items()})
    assert {r["bundle_id"]: r["problem"] for r in migration.refused(parsed, "tool/1").collect()} == {"broken": "bundle-not-parseable", "bytes": "bundle-not-parseable", "rootless": "root-index-missing", "mute": "version-missing", "other": "version-unsupported", "anchored": "version-not-plain"}
    assert {r["bundle_id"] for r in migration.plan(parsed, "tool/1").collect()} == {"fine"}
