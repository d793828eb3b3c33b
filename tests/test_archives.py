"""Archives read in groups of chunks."""

import io
import random

import pytest

from tidewatch.sources import files

from .test_sources import archive


class Watched(io.BytesIO):
    """Tells which bytes were read."""

    def __init__(self, raw):
        super().__init__(raw)
        self.seen = []

    def read(self, n=-1):
        at = self.tell()
        got = super().read(n)
        self.seen.append((at, at + len(got)))
        return got


@pytest.mark.parametrize("seed", range(40))
def test_groups_are_lines(seed):
    """Whatever the groups, their lines are those of the archive: lines over many chunks, empty chunks, no LF at the end."""
    rng = random.Random(seed)
    chunks = [b"".join(rng.choice([b"a", b"bc", b"\r\n", b"\n"] if rng.random() < 0.7 else [b"x"]) for _ in range(rng.choice([0, 1, 3, 9]))) for _ in range(rng.choice([1, 4, 12]))]
    raw = archive(*chunks, stored=seed % 2 == 0)
    ends = [c.end for c in files.zlg_index(io.BytesIO(raw))]
    assert b"".join(files.zlg_data(io.BytesIO(raw), c) for c in files.zlg_index(io.BytesIO(raw))) == b"".join(chunks)
    for start in (0, ends[len(ends) // 2], ends[0] - 1):
        want = list(files.lines_of("x.zlg", raw, start=start))
        for most in (1, 150, 400, 1 << 20):
            groups = files.zlg_groups(io.BytesIO(raw), start, most)
            assert [g[0] for g in groups[1:]] == [g[1] for g in groups[:-1]]
            assert [x for g in groups for x in files.group_lines(io.BytesIO(raw), g)] == want


def test_earlier_chunks_are_not_read():
    raw = archive(*[b"line of chunk %d\n" % i * 200 for i in range(20)], stored=True)
    chunks = list(files.zlg_index(io.BytesIO(raw)))
    held = lambda f: sum(b - a for a, b in f.seen)
    f = Watched(raw)
    assert [x[0] for x in files.zlg_chunks(f, chunks[17].end)] == [c.start for c in chunks[18:]]
    assert held(f) < 3 * chunks[0].packed + 20 * 64 + 400
    f = Watched(raw)
    groups = files.zlg_groups(f, chunks[9].end, 1)
    assert len(groups) == 10 and held(f) < 20 * 64 + 400  # headers alone
    f = Watched(raw)
    assert len(list(files.group_lines(f, groups[5]))) == 200
    assert {c.start for c in chunks for a, b in f.seen if a < c.end and b > c.start + 64} == {chunks[14].start, chunks[15].start}


def test_many_tasks(spark, tmp_path, monkeypatch):
    """An archive of many groups has the lines, offsets and numbers of one read whole; a broken chunk takes all of them."""
    monkeypatch.setattr(files, "GROUP", 1)
    monkeypatch.setattr(files.zlg_groups, "__defaults__", (0, 1))
    folder = tmp_path / "t" / "d"
    folder.mkdir(parents=True)
    raw = archive(*[b"%d a\n%d b\n%d" % (i, i, i) for i in range(30)])
    (folder / "good.zlg").write_bytes(raw)
    cut = bytearray(archive(b"x\n", b"y\n", stored=True))
    cut[cut.index(b"y\n")] = ord("z")
    (folder / "bad.zlg").write_bytes(bytes(cut))
    found, failed = files.read_parts(spark, str(tmp_path))
    got = sorted((r.line_no, r.offset_start, r.offset_end, r.byte_len, r.line) for r in found.collect())
    want = [(i, *x) for i, x in enumerate(files.lines_of("x.zlg", raw))]
    assert got == want and [(r.file_rel, "chunk" in r.error) for r in failed.collect()] == [("bad.zlg", True)]
    at = want[40][2]
    cursors = spark.createDataFrame([("t", "d", "good.zlg", at)], "tenant_id string, device_dir string, file_rel string, offset long")
    later = files.read_lines(spark, str(tmp_path), cursors=cursors)
    assert sorted((r.line_no, r.offset_start, r.offset_end, r.byte_len, r.line) for r in later.collect()) == [(i, *x) for i, x in enumerate(files.lines_of("x.zlg", raw, start=at))]
    assert found.select("offset_start").distinct().count() == 30
