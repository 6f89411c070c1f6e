"""Files read by ranges of bytes give the lines that they give when they are read whole."""

import random

import pytest

from tidemark.sources import lines
from tidemark.sources.lines import LineReader, Range, ranges, read_file


def plain(data, most):
    out, parts = [], data.split(b"\n")
    for k, p in enumerate(parts):
        ended = k + 1 < len(parts)
        if p or ended:
            raw = p.removesuffix(b"\r")
            text = raw[:most].decode("utf-8", "replace")
            out.append((len(out) + 1, text.rstrip("\ufffd") if len(raw) > most else text, len(p) + ended))
    return out


def texts():
    rng = random.Random(3)
    yield from (b"", b"\n", b"a", b"\r\n", b"a\r\r\n", b"\n\n\n", b"a\nb", b"\xff\n", "é\nçç\r\nx".encode())
    for _ in range(8):
        yield b"".join(rng.choice([b"\n", b"\r\n", b"\r", b"a", b"bcd", "é".encode(), "日本".encode(), b" " * 7]) for _ in range(rng.randint(0, 60)))


def test_ranges_of_any_size_in_process(tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "MAX_LINE", 9)
    for data in texts():
        (tmp_path / "f").write_bytes(data)
        for split in (1, 3, 50):
            for block in (1, 4, 1 << 20):
                monkeypatch.setattr(lines, "BLOCK", block)
                cuts = [(a, min(len(data), a + split)) for a in range(0, len(data), split)]
                n = [b["n"][0].as_py() for k, (a, z) in enumerate(cuts) for b in LineReader("", split, True).read(Range(str(tmp_path / "f"), k, a, z, 0))]
                got = [row for k, (a, z) in enumerate(cuts) for b in LineReader("", split, False).read(Range(str(tmp_path / "f"), k, a, z, sum(n[:k]))) for row in zip(*(b[c].to_pylist() for c in ("seq", "line", "raw_len")), strict=True)]
                assert got == plain(data, 9), (data, split, block)


def test_files_by_ranges_and_whole(spark, tmp_path):
    rng = random.Random(4)
    folder = tmp_path / "logs"
    folder.mkdir()
    long = b"x" * (lines.MAX_LINE - 1) + "é tail".encode() + b"\r\nafter\n"
    bodies = {"a.log": b"".join(f"line {i} é\r\n".encode() if i % 3 else b"\n" for i in range(20_000)), "b.log": long, "c.log": b"short", "d.log": b""}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    (folder / "_hidden").write_bytes(b"no\n")
    want = sorted((seq, text, n) for body in bodies.values() for seq, text, n in plain(body, lines.MAX_LINE))
    for split in (60_000, 1 << 30):
        got = read_file(spark, str(folder), "stdout", split=split, run_id="r")
        assert got.columns == ["run_id", "stream", "seq", "line", "raw_len"]
        assert sorted((r["seq"], r["line"], r["raw_len"]) for r in got.collect()) == want
    one = ranges(spark, [str(folder / "a.log")], 60_000)
    assert one.rdd.getNumPartitions() == -(-len(bodies["a.log"]) // 60_000)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_file(spark, str(tmp_path / "none")).count()
