"""Line dedup against a comparison of all pairs of lines."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(table, edits=2, small=10, near=24):
    """(doc_id, text) rows to the texts that stay."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in table if t is not None})
    first, drop = {}, defaultdict(set)
    for n, (_, _, t) in enumerate(order):
        for no, raw in enumerate(t.split("\n")):
            line = raw.strip(" \t\r")
            if len(line) >= small:
                if line in first:
                    drop[n].add(no)
                else:
                    first[line] = (n, no)
    long = sorted((x for x in first if len(x) >= near), key=first.get)
    for i, b in enumerate(long):
        if any(abs(len(a) - len(b)) <= edits and distance(a, b) <= edits for a in long[:i]):
            drop[first[b][0]].add(first[b][1])
    stays = {(d, t): "\n".join(x for no, x in enumerate(t.split("\n")) if no not in drop[n]) for n, (_, d, t) in enumerate(order)}
    return sorted(((d, None if t is None else stays[d or 0, t]) for d, t in table), key=str)


def got(df, **limits):
    return sorted(((r.doc_id, r.text) for r in lines.dedup_lines(df, **limits).collect()), key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 6)))
    base = [" ".join(word() for _ in range(rng.randrange(2, 12))) for _ in range(25)]
    table = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(5)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "yz"])
            out.append("".join(x))
        table.append((i, "\n".join(out)))
    return table


@pytest.mark.parametrize(("edits", "bucket"), [(2, 16), (2, 2), (1, 2)])
def test_dedup_equals_all_pairs(spark, edits, bucket):
    table = made(edits * 10 + bucket)
    df = spark.createDataFrame(table, "doc_id long, text string")
    # by id alone: ids don't repeat here
    assert got(df, max_edits=edits, bucket_lines=bucket) == plain(table, edits)


def test_edit_bands(spark):
    rng = random.Random(4)
    rows = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc")]
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(12)))
        rows.append((a, "".join(rng.choice("ab") for _ in range(max(0, len(a) + rng.randrange(-3, 4))))))
    for edits in (1, 2, 3):
        want = sorted(r for r in rows if distance(*r) <= edits)
        assert sorted(map(tuple, lines.within_edits(spark.createDataFrame(rows, "left string, right string"), edits).collect())) == want


def test_odd_tables(odd, none):
    few = odd.filter("doc_id IS NULL OR doc_id <> 4").withColumn("text", F.concat("text", F.lit("\nshared line of some length\n  shared line of some length\r")))
    out = lines.dedup_lines(few)
    assert out.columns == few.columns
    assert sum((r.text or "").count("shared line") for r in out.collect()) == 1
    assert lines.dedup_lines(none).count() == 0 and lines.line_report(odd).count() == odd.count()


def test_report_on_documents(docs):
    table = [tuple(r) for r in docs.select("doc_id", "text").collect()][:120]
    df = docs.sparkSession.createDataFrame(table, "doc_id long, text string")
    report = lines.line_report(df).collect()
    assert sorted((r.doc_id, r.text) for r in report) == sorted(plain(table))
    for r in report:
        whole = dict(table)[r.doc_id].split("\n")
        assert r.n_lines == len(whole) and r.n_exact + r.n_near == len(whole) - (len(r.text.split("\n")) if r.text or len(whole) > r.n_exact + r.n_near else 0)


def test_keys_compile(spark, tmp_path):
    """Keys written out in full were more code than Spark compiles; it then went on without, after much work in the driver."""
    spark.createDataFrame(made(1), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert got(spark.read.parquet(str(tmp_path / "t")), bucket_lines=2) == plain(made(1))
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
