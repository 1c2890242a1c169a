"""The corpus pipeline stage by stage against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
import pytest

from ledgerline.llm import packing, quality

from .conftest import DATA
from .test_jaccard import plain_components
from .test_row_operators import plain_hits

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and result, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    names = list(stages)
    assert names == ["quality_rules", "line_dedup", "jaccard_join", "benchmark_decontamination", "window_packing"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.count() > 0


def test_quality_rules(spark, stages):
    before, after = stages["quality_rules"]
    field = quality.fit_line_field(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(after)) == {d for d, t in texts(before).items() if quality.judge(t, field, 20, 30, 0.5)[6]}


def test_line_dedup(stages):
    before, after = (texts(x) for x in stages["line_dedup"])
    assert set(before) == set(after)
    seen = Counter(x.strip(" \t\r") for t in after.values() for x in t.split("\n"))
    assert all(n == 1 for x, n in seen.items() if len(x) >= 10)
    for d, t in after.items():  # lines go, none is changed or moved
        rest = iter(before[d].split("\n"))
        assert t == "" or all(x in rest for x in t.split("\n"))
    whole = Counter(x.strip(" \t\r") for t in before.values() for x in t.split("\n"))
    kept_short = Counter(x for t in after.values() for x in t.split("\n") if len(x.strip(" \t\r")) < 10)
    assert sum(n for x, n in whole.items() if 0 < len(x) < 10) == sum(n for x, n in kept_short.items() if x.strip(" \t\r"))
    assert {r.doc_id: r.n_chars for r in stages["line_dedup"][1].collect()} == {d: len(t) for d, t in after.items()}


def test_jaccard_join(stages):
    before, after = stages["jaccard_join"]
    table = [tuple(r) for r in before.select("doc_id", "text").collect()]
    assert set(texts(after)) == {d if not n else c for d, n, c in plain_components(table, 5, 80)}


def test_decontamination(spark, stages):
    before, after = (texts(x) for x in stages["benchmark_decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(after) == {d for d, t in before.items() if not plain_hits(t, items)[1]}


def test_packing(stages):
    before, after = stages["window_packing"]
    tokens = Counter()
    for r in after.collect():
        tokens[r.doc_id] += r.length
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    assert dict(tokens) == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(before).items()}


def test_run_gives_the_last_stages_rows(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    a, b = (sorted(map(tuple, df.select(*key).collect())) for df in (corpus_pipeline.run(spark, SF), stages["window_packing"][1]))
    assert sum(r[2] for r in a) == sum(r[2] for r in b) and {r[0] for r in a} == {r[0] for r in b}


def test_odd_tables(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "window_packing":
                assert out.columns == docs.columns and out.count() <= docs.count()
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
