import random

from pyspark.sql import functions as F

from wicker.functions import commonmark, plain, yaml
from wicker.operators.structure import Places
from wicker.sources import tables

BITS = [": ", "# ", "- ", "\n", "\n\n", "[", "]", "(", ")", "{", "}", ", ", '"', "a", "1", "true", "null", "~", "`", "!", "*", "_", "1. ", "  ", "\t", "&a ", "---\n", "===\n", "<b>", "\\", "]: x", "- a\n", "key: v\n", "[x](y)", "0x1f", "1e5", ".inf"]


def parts(text):
    end = text.find("\n---\n", 3)
    return text[4 : end + 1], text[end + 5 :]


def said(read, text):
    try:
        return read(text)
    except yaml.Failure as problem:
        return str(problem)


def test_plain_forms_are_read_as_the_readers_read_them(spark, sf_dir):
    every = [tables.documents, tables.notes, tables.nation_bundles]
    texts = [parts(r[0]) for make in every for r in make(spark, sf_dir).select(F.col("content").cast("string")).collect()]
    dealt, read = random.Random(3), [0, 0]
    for front, body in texts + [dealt.choice(texts) for _ in range(4000)]:
        for k, (text, quick, whole) in enumerate(((front, plain.front, yaml.read), (body, plain.body, commonmark.read))):
            for _ in range(dealt.choice((0, 1, 2))):
                at = dealt.randint(0, len(text))
                text = text[:at] + dealt.choice(BITS) + text[at + dealt.choice((0, 0, 1)) :]
            found = quick(text)
            read[k] += found is not None
            assert found is None or found == said(whole, text), text
    assert min(read) > 1000


def test_nearly_all_tables_documents_are_plain(spark, sf_dir):
    texts = [parts(r[0]) for r in tables.documents(spark, sf_dir).select(F.col("content").cast("string")).collect()]
    assert sum(plain.front(f) is not None and plain.body(b) is not None for f, b in texts) > 0.95 * len(texts)


def test_ranges_of_plain_texts_are_those_of_points():
    raw = "ab\n\ncd e\n\nf"
    places = Places(raw)
    for start in range(len(raw) + 2):
        for end in range(len(raw) + 2):
            assert places.range(start, end) == (*places.point(start), *places.point(max(start, end)))
