"""Reports whose preamble reaches over any number of splits."""

import pytest

from seriesloom.sources.tables import read_skip_preamble


@pytest.mark.parametrize("skip", [0, 1, 12, 40])
@pytest.mark.parametrize("split", ["40", "200", "1m"])
def test_preamble_is_dropped_whatever_the_splits(spark, tmp_path, skip, split):
    want = []
    for k, rows in enumerate((3, 60, 500)):
        data = [f"id{k}_{i}\t{i}.5" for i in range(rows)]
        (tmp_path / f"part{k}.txt").write_text("\n".join([f"# line {i} of the preamble" for i in range(skip)] + data) + "\n")
        want += [(f"id{k}_{i}", i + 0.5) for i in range(rows)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_skip_preamble(spark, str(tmp_path), skip, "id string, v double").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == sorted(want)


def test_files_shorter_than_the_preamble_hold_no_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# one\n# two\n")
    (tmp_path / "b.txt").write_text("# one\n# two\n# three\nx\t1.0\n")
    assert [tuple(r) for r in read_skip_preamble(spark, str(tmp_path), 3, "id string, v double").collect()] == [("x", 1.0)]
