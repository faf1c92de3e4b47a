"""The export parser: headers, continuation lines, marks, placeholders and what it refuses."""

from __future__ import annotations

import datetime
import random

import pytest

from threadloom.sources.chats import line_problems, parse_lines, parse_messages, parse_problems, read_exports, scan_exports

EXPORT = "\n2026/01/05, 14:03 - Ann: hello: there\r\nsecond line\r\n‎2026/01/05, 14:04 - Bob: <Media omitted>\n2026/01/05, 14:05 - Ann left\n2026/1/5, no header\n"


def test_messages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(EXPORT.encode())
    exports = read_exports(spark, str(tmp_path))
    rows = sorted(parse_messages(exports).collect(), key=lambda r: r["sequence_number"])
    assert [tuple(r)[1:] for r in rows] == [
        (1, datetime.datetime(2026, 1, 5, 14, 3), "User", "Ann", "hello: there\nsecond line", "2026/01/05, 14:03 - Ann: hello: there\nsecond line", 2, 3, False),
        (2, datetime.datetime(2026, 1, 5, 14, 4), "User", "Bob", "<Media omitted>", "‎2026/01/05, 14:04 - Bob: <Media omitted>", 4, 4, True),
        (3, datetime.datetime(2026, 1, 5, 14, 5), "System", None, "Ann left\n2026/1/5, no header", "2026/01/05, 14:05 - Ann left\n2026/1/5, no header", 5, 6, False),
    ]
    assert parse_problems(exports).count() == 0


def test_problems(spark):
    bad = spark.createDataFrame([("x", "text\n2026/02/30, 10:00 - A: b\n2026/02/03, 10:00 - : c"), ("y", None), ("z", "")], "doc string, value string")
    assert {tuple(r) for r in parse_problems(bad).collect()} == {("x", 1, "TextBeforeFirstMessage"), ("x", 2, "ImpossibleTime"), ("x", 3, "EmptySender")}
    assert parse_messages(bad.where("doc <> 'x'")).count() == 0
    with pytest.raises(Exception, match="line [123]: (TextBefore|Impossible|Empty)"):
        parse_messages(bad).count()
    assert [(r["sequence_number"], r["message_time"]) for r in parse_messages(bad, strict=False).orderBy("sequence_number").collect()] == [(1, None), (2, datetime.datetime(2026, 2, 3, 10, 0))]


def test_ranges_make_no_difference(spark, tmp_path):
    """Files cut anywhere, also within a line, a header, a character or the end of a line, give the rows of whole texts."""
    draw = random.Random(6)
    pieces = ["2026/01/05, 14:03 - Ann: hello", "2026/01/05, 14:04 - Bob: <Media omitted>", "2026/01/06, 09:00 - Ann left", "more: text", "", "\u200e2026/01/05, 14:05 - Ünal: ß", "é" * 40, "2026/1/5, no header"]
    for name in ("a.txt", "b c.txt", "empty.txt", "blank.txt", "bad.txt"):
        end = lambda: draw.choice(["\n", "\r\n", "\r"])
        lines = [] if name == "empty.txt" else ["", " "] if name == "blank.txt" else ["", pieces[0], *draw.choices(pieces, k=40), draw.choice(["", "last"])]
        if name == "bad.txt":
            lines = ["too early", *lines, "2026/02/30, 10:00 - A: b", *draw.choices(pieces, k=9)]
        (tmp_path / name).write_bytes("".join(x + end() for x in lines).encode()[: None if draw.random() < 0.5 else -1])
    exports = read_exports(spark, str(tmp_path))
    name = lambda r: r["doc"].rsplit("/", 1)[1]
    key = lambda df: sorted((name(r), *map(str, r[1:])) for r in df.collect())
    want, problems = key(parse_messages(exports, strict=False)), key(parse_problems(exports))
    assert len(want) > 30 and len(problems) == 2
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (23, 300, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            lines = scan_exports(spark, str(tmp_path))
            assert key(parse_lines(lines, strict=False)) == want and key(line_problems(lines)) == problems, size
            assert lines.rdd.getNumPartitions() > (20 if size < 100 else 0)
        with pytest.raises(Exception, match="line"):
            parse_lines(lines).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
