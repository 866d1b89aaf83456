"""The pipeline's stages: what they decide takes effect on all that the stage before kept."""

import importlib
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from phenolith.llm import sp_bpe

from .test_operators import brute_components, brute_hits, edited, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, prose(i, 60)) for i in range(120)]
    toxic = [(200 + i, prose(300 + i, 30) + " moronic scumbag " + prose(600 + i, 10)) for i in range(120)]
    near = [(500 + i, edited(prose(1, 60), i, 1)) for i in range(4)] + [(510, prose(2, 60)), (510, prose(2, 60)), (511, None), (512, ""), (513, "")]
    item = prose(999, 30)
    leak = [(520, prose(5000, 20) + " " + item), (521, prose(5001, 400) + " " + " ".join(item.split()[:14]))]
    private = [(530, prose(5002, 30) + " mail a.b@c.example.org +1 (222) 555-1234")]
    rows = clean + toxic + near + leak + private
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic[:100]], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_stages(spark, tables):
    d, rows, item = tables
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    plain = [(i, t) for i, t in rows if not 200 <= i < 320]
    assert sorted(r.doc_id for r in kept[0]) == sorted(i for i, _ in plain)
    alone = {i for i, _, c in brute_components(plain, 5, 80) if c == i}
    assert sorted(r.doc_id for r in kept[1]) == sorted(alone)
    dirty = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in kept[1]], [(1, item)], 13) if r[-1]}
    assert dirty == {520} and sorted(r.doc_id for r in kept[2]) == sorted(alone - dirty)
    before, after = {r.doc_id: r.text for r in kept[2]}, {r.doc_id: r.text for r in kept[3]}
    assert {i for i in before if before[i] != after[i]} == {530} and "a.b@c" not in after[530] and "555-1234" not in after[530]
    lib = sp_bpe.library(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    for r in kept[4]:
        assert np.frombuffer(r.ids, "<u4").tolist() == lib.encode(after[r.doc_id] or "", add_bos=True, add_eos=True)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (5, edited(a, 1, 1)), (5, b), (7, c), (7, edited(c, 2, 1)), (7, c), (8, edited(c, 3, 1)), (9, None), (9, ""), (9, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    alike = lambda k, t: {0: t == a, 1: t == b, 2: t in {x for i, x in rows if i == 7}}[k]
    assert [i for i, t in kept if t and i is not None and alike(0, t)] == [1] and (5, b) in kept
    assert len([1 for i, t in kept if t and alike(2, t)]) == 1 and (5, edited(a, 1, 1)) not in kept
    assert sorted(i for i, _ in kept if i is not None) == [1, 5, 7, 9, 9] and kept.count((None, a)) == 2


def test_run_and_empty_input(spark, tables, tmp_path):
    d, rows, _ = tables
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < len(rows)
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['phenolith.llm'] = None; import phenolith, phenolith.cli, phenolith.plans.catalogue, phenolith.streaming.aggregate"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("corpus_pipeline").__file__.rsplit("/", 1)[0])
