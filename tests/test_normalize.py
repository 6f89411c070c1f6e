import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ids import behavior_id, behavior_ids, fnv1a64, fnv1a64_all, mix64
from tidemark.functions.normalize import Roots, normalize, normalized, slot_value, template_of

CASES = [
    ("\x1b[32mdone\x1b[0m in (1.5ms)", "done in (<duration>)"),
    ("worker 7 took 12 seconds, 3.5 seconds of it waiting", "worker <int> took <duration> of it waiting"),
    ('WHERE name = \'O\'\'Hara\' AND city LIKE \'x%\'', "WHERE name = <quoted> AND city LIKE <quoted>"),
    ('"users"."id" = $1  [["id", 5], ["mail", "a@b.org"]]', '"users"."id" = $<int> [["id", <int>], ["mail", <quoted>]]'),
    ("ids (4, 5, 6) on 2023-02-03 04:05:06 +0100", "ids (<int>) on <timestamp>"),
    ("rev=0badc0ffee1 by zoe@mail.example.net tag v2.0.1 of 64MB", "rev=<hex> by <email> tag <version> of <size>"),
    ("Mar  3 01:02:03 host-b sshd[99]: closed", "<timestamp> <host> sshd[<int>]: closed"),
    (" Mar 3 01:02:03 host-b sshd[99]: closed", "Mar <int> <timestamp> host-b sshd[<int>]: closed"),
    ("saw <SECRET_3> from [::1]:80 and 10.1.2.3", "saw <SECRET> from [<ip>]:<int> and <ip>"),
    ("part=17-123e4567-e89b-12d3-a456-426614174000", "part=<int>-<uuid>"),
    ("plain words stay as they are", "plain words stay as they are"),
    ("v1.0x is no version, v1.0-x is", "v1.0x is no version, <version> is"),
    ("it ends... here. And e.g. there", "it ends... here. And e.g. there"),
    ("", ""),
]


@pytest.mark.parametrize(("line", "want"), CASES)
def test_templates(line, want):
    assert normalize(line).template == want


def test_slots_point_into_the_line_as_it_came():
    line = "\x1b[1mItem Load (0.3ms)\x1b[0m WHERE id = 7 in 1 minute 3.5 seconds, wrote 2KB"
    got = [(k, line[a:b], slot_value(k, line[a:b])) for k, a, b in normalize(line).slots]
    assert got == [("duration", "0.3ms", 0.3), ("int", "7", 7.0), ("duration", "1 minute 3.5 seconds", 63_500.0), ("size", "2KB", 2048.0)]


@pytest.mark.parametrize(("roots", "line", "want", "roles"), [
    (Roots("/Users/kim/work/shop"), "in /Users/kim/work/shop/app/pages/list.html.erb:7", "in <root>/app/pages/list.html.erb:<int>", ["source", "view"]),
    (Roots(), "in /home/kim/work/list.html.erb:7", "in ~/work/list.html.erb:<int>", ["view"]),
    (Roots(), "kept /tmp/0a1b2c3d4e5f-77-k/part.bin", "kept <tmp>/<tmpname>/part.bin", ["temp"]),
    (Roots(), "kept /tmp/photo-77.png", "kept <tmp>/<tmpname>.png", ["temp"]),
    (Roots(), "/usr/lib/gems/json-2.6.1/lib/json.rb:5", "<gem:json>/lib/json.rb:<int>", ["dependency"]),
])
def test_paths(roots, line, want, roles):
    n = normalize(line, roots)
    assert (n.template, n.roles) == (want, roles)


def test_hashes_that_never_change():
    # Published test vectors of FNV-1a.
    assert [fnv1a64(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert mix64(0) == 0 and behavior_id("log", "x") != behavior_id("logx", "") and len(behavior_id("log", "x")) == 16


def test_hashes_of_many_strings_at_once(spark):
    r = random.Random(5)
    texts = ["", "a", "é" * 50, None, "x" * 5000, *("".join(r.choice("abcé ") for _ in range(r.randint(0, 90))) for _ in range(300))]
    got = fnv1a64_all(pa.array(texts, pa.string()))
    assert got.tolist() == [fnv1a64((t or "").encode()) for t in texts]
    assert fnv1a64_all(pa.array(texts, pa.string()).slice(7, 40)).tolist() == got[7:47].tolist() and fnv1a64_all(pa.array([], pa.string())).dtype == np.uint64
    rows = spark.createDataFrame([(k, t) for k in ("log", "db.query", None) for t in texts], "k string, t string")
    for k, t, b in rows.select("k", "t", behavior_ids("k", "t")).collect():
        assert b == (None if k is None or t is None else behavior_id(k, t))


def test_lines_of_a_table(spark):
    lines = ["took 5ms", "took 6ms", "took 5ms", None, ""]
    rows = normalized(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    assert [r["normal"]["template"] for r in rows] == ["took <duration>"] * 3 + ["", ""] and rows[0]["normal"]["slots"][0]["value"] == 5.0
    assert rows[0]["normal"]["template_hash"] % (1 << 64) == fnv1a64(b"took <duration>")


def test_the_jvm_masks_what_the_normalizer_does(spark):
    """Lines that stay in the JVM have the template that the normalizer gives them; so have all others."""
    r = random.Random(6)
    parts = ["word", "Éte", "a.b", "end.", "...", "x,y", "(so)", "-dash-", "a_b", "7", "a1", "'q'", '"q"', "k=v", "p/q", "::", "~/x", "<b>", "\t", "  ", "e@f.org", "\\n", "\x1b[1m", "\r", "\u00a0", "#!?", "%$&*+;|{}[]^`", "µs"]
    lines = [case for case, _ in CASES] + ["".join(r.choice(parts) + r.choice([" ", "", " "]) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", template_of(F.col("line")).alias("t")).collect()
    assert [x["t"] for x in rows] == [normalize(x["line"]).template for x in rows]
