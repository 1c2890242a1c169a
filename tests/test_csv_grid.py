"""CSV files read in splits against the standard library's reader."""

import csv
import io
import random

from ledgerline.operators.grid import read_csv_grid


def test_splits_anywhere(spark, tmp_path):
    """Files of many splits of 300 bytes: quotes open across split ends, rows of any length, empty lines, both line ends."""
    rng = random.Random(9)
    cells = ["", "a", "b c", "x,y", 'say "hi"', "two\nlines", '"', "\n\n,", "é—ß", " pad ", "0"]
    want = {}
    for name in ("one", "two"):
        out = io.StringIO()
        for _ in range(400):
            if rng.random() < 0.1:
                out.write("\n")
            else:
                csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerow([rng.choice(cells) for _ in range(rng.randrange(1, 6))])
        text = ("﻿" if name == "one" else "") + out.getvalue()
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        want[name] = list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = read_csv_grid(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, rows in want.items():
        mine = sorted((r.row_no, r.cells) for r in got if name in r.sheet)
        assert [n for n, _ in mine] == list(range(1, len(rows) + 1))
        assert [c for _, c in mine] == rows


def test_long_cells_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"' + 'long ""text"" ' * 20_000 + '",y\n')
    (tmp_path / "b.csv").write_text("")
    (row,) = read_csv_grid(spark, str(tmp_path)).collect()
    assert row.cells == ["x", 'long "text" ' * 20_000, "y"]
