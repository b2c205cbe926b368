import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from structsim.llm import decontaminate, language_id, ngram_join, secret_scan
from structsim.llm.tokens import default_tokenizer, encoder
from tests.llm.test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The documents after each stage."""
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()]
    for _, stage in P.STAGES:
        frame = spark.createDataFrame(docs[-1])
        docs.append(stage(spark, frame, SMALL).toPandas())
    return docs


def test_stages_against_brute_force(spark, steps):
    raw, spoken, single, clean, blank, packed = steps
    columns = list(raw.columns)
    assert all(list(s.columns) == columns for s in (spoken, single, clean, blank))
    assert set(raw.doc_id) - set(spoken.doc_id) <= {d for d, t in zip(raw.doc_id, raw.text, strict=True) if not any(c.isalpha() for c in t or "")}
    groups = brute(list(zip(spoken.doc_id, spoken.text, strict=True)), 5, 80)
    assert sorted(single.doc_id) == sorted(d for d, (_, c) in groups.items() if d == c)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas()
    dirty = {d for d, t in zip(single.doc_id, single.text, strict=True) if any(b in t for b in bench.text)}
    assert set(single.doc_id) - set(clean.doc_id) == dirty
    assert sorted(blank.doc_id) == sorted(clean.doc_id)
    was = dict(zip(clean.doc_id, clean.text, strict=True))
    assert all(t == secret_scan.redacted(was[d]) and n == len(t) for d, t, n in zip(blank.doc_id, blank.text, blank.n_chars, strict=True))
    assert not any(secret_scan.direct_spans(t) for t in blank.text)
    lengths = {d: len(encoder(default_tokenizer()).plain(t)) + 1 for d, t in zip(blank.doc_id, blank.text, strict=True)}
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths


def test_run_equals_the_stages(spark, steps):
    got = P.run(spark, SMALL).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got[key].sort_values(key).to_numpy().tolist() == steps[-1][key].sort_values(key).to_numpy().tolist()


def test_stages_take_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    names = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == names
    assert P.STAGES[-1][1](spark, docs, SMALL).count() > 0
    empty = table([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_registered_once_each():
    names = list(entry.queries())
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert np.array([s[0] for s in P.STAGES]).tolist() == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    assert all(m.__doc__ for m in (decontaminate, language_id, ngram_join, secret_scan))
