"""Documents one a line are read as those of one a file, and the queries over them write few files."""

import os

from hearthlake.plans import file_queries
from hearthlake.session import shared_dir
from hearthlake.sources import files


def test_lines_give_what_files_give(spark, tmp_path):
    packed = '{"v":2,"cols":["id","agent"],"dict":{"agent":["A","B"]},"imgPrefixes":[],"urlPrefix":"u","rows":[["%d","1"],["%d",null]]}'
    os.makedirs(tmp_path / "files"), os.makedirs(tmp_path / "lines")
    for i in range(4):
        (tmp_path / "files" / f"{i}.json").write_text(packed % (2 * i, 2 * i + 1))
    (tmp_path / "lines" / "all.json").write_text("\n".join(packed % (2 * i, 2 * i + 1) for i in range(4)))
    read = lambda name, lines: sorted((r["id"], sorted(r["facts"].items())) for r in files.unpacked(spark, str(tmp_path / name), lines).collect())
    assert read("lines", True) == read("files", False) and len(read("lines", True)) == 8


def test_documents_are_no_files_of_their_own(spark):
    rows = spark.range(1000)
    folder = file_queries.documents(rows, "id", rows["id"].cast("string"), ("[", "]"))
    assert folder.startswith(shared_dir(spark)) and spark.read.text(folder).count() == 20
    assert len(spark.read.text(folder).inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
