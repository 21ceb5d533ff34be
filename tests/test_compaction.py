"""Small files packed by size: whole after every failure, gone only after the commit."""

import gzip
import os

import pytest

from hearthlake.operators.compaction import PageArchive, binned, file_sizes
from hearthlake.operators.versions import SnapshotLog


@pytest.fixture
def folder(tmp_path):
    os.makedirs(tmp_path / "in" / "deep")
    for i in range(40):
        (tmp_path / "in" / ("deep" if i % 2 else "") / f"k{i:02d}.html.gz").write_bytes(gzip.compress(f"<p>page {i}</p>".encode() * (200 if i == 7 else 1)))
    return str(tmp_path / "in")


def keys(archive):
    return sorted((r["key"], r["html"][:12]) for r in archive.pages().collect())


def test_bins_fill_up_to_the_target(spark):
    sizes = [(f"f{i:03d}", n) for i, n in enumerate([10, 20, 30, 500, 5, 90, 95, 1, 1, 1])]
    bins = {}
    for r in binned(spark.createDataFrame(sizes, "path string, length long").coalesce(1), 100).collect():
        bins.setdefault(r["bin"], []).append(r["length"])
    assert sum(map(len, bins.values())) == 10 and [500] in bins.values()
    # A bin takes the files that begin before its end, so it passes the target by less than one file.
    assert all(sum(x) < 100 + max(x) or len(x) == 1 for x in bins.values()) and len(bins) < 10


def test_packs_reports_and_removes(spark, folder, tmp_path):
    archive = PageArchive(spark, f"{tmp_path}/archive")
    before = file_sizes(spark, folder).groupBy().sum("length").first()[0]
    report = archive.pack(folder, 1000).first()
    assert (report["files"], report["bytes"]) == (40, before) and report["packed"] < 40
    assert [k for k, _ in keys(archive)] == [f"k{i:02d}" for i in range(40)] and file_sizes(spark, folder).count() == 0
    assert archive.pack(folder) is None
    with open(f"{folder}/k03.html", "w") as f:
        f.write("<p>later</p>")
    archive.pack(folder)
    assert len(keys(archive)) == 41 and archive.pages_by_key().where("key = 'k03'").first()["html"] == "<p>later</p>"


def test_a_failed_commit_leaves_the_files(spark, folder, tmp_path, monkeypatch):
    archive = PageArchive(spark, f"{tmp_path}/archive")

    def fails(*a):
        raise OSError("disk full")

    monkeypatch.setattr(SnapshotLog, "publish", fails)
    with pytest.raises(OSError, match="disk full"):
        archive.pack(folder, 1000)
    monkeypatch.undo()
    assert file_sizes(spark, folder).count() == 40 and archive.pages() is None
    monkeypatch.setattr(PageArchive, "remove", fails)
    with pytest.raises(OSError, match="disk full"):
        archive.pack(folder, 1000)  # committed, but nothing is removed
    monkeypatch.undo()
    archive.pack(folder, 1000)
    assert file_sizes(spark, folder).count() == 0 and archive.pages_by_key().count() == 40


def test_packs_some_folders_at_a_time(spark, tmp_path):
    """The driver lists a round's files, not all; a folder goes whole, unless something else has come into it."""
    for i in range(60):
        at = tmp_path / "in" / f"d{i % 5}" / ("deep" if i % 2 else "")
        os.makedirs(at, exist_ok=True)
        (at / f"k{i:02d}.html").write_text(f"<p>page {i}</p>")
    (tmp_path / "in" / "own.html").write_text("<p>own</p>")
    # What a call that broke off had taken aside is found again.
    os.rename(tmp_path / "in" / "d4", tmp_path / "in" / ".packed-0-d4")
    archive, rounds, gone = PageArchive(spark, f"{tmp_path}/archive"), [], []
    pack_round = archive.pack_round

    def counted(folders, *rest):
        found = pack_round(folders, *rest)
        rounds.append(found and found[0])
        return found

    whole = archive.removed_whole

    def late(folder, *rest):
        if folder.getName() == "d1":
            (tmp_path / "in" / "d1" / "late.html").write_text("<p>late</p>")
        gone.append((folder.getName(), whole(folder, *rest)))
        return gone[-1][1]

    archive.pack_round, archive.removed_whole = counted, late
    report = archive.pack(f"{tmp_path}/in", most=30).first()
    assert [k for k, _ in keys(archive)] == [*(f"k{i:02d}" for i in range(60)), "late", "own"]
    assert (report["files"], len(rounds)) == (62, 4) and max(filter(None, rounds)) <= 30 and len(archive.log.numbers()) == 4
    assert file_sizes(spark, f"{tmp_path}/in").count() == 0 and sorted(gone) == [(f"d{i}", i != 1) for i in range(5)]
