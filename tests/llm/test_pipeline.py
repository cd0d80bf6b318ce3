"""The stages, one after the other, against brute force on a small fixture."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_exact_dedup import brute as exact_brute
from .test_near_docs import shingles
from .test_packing import VOCABULARY
from .test_simhash import slow_components
from .test_suffix import brute as suffix_brute
from .test_toxicity import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    base = corpus(300, 2)
    passage = base[0][1][:160]
    rows = [(d, t, lang, "s0", len(t)) for d, t, lang, _ in base]
    rows += [(400 + i, base[i][1] + " \n", base[i][2], "s1", 0) for i in range(30)]
    rows += [(500 + i, base[i][1] + " " + "x", base[i][2], None, None) for i in range(30, 60)]
    rows += [(600 + i, base[i][1][: int(rng.integers(5, 60))] + passage + base[i + 50][1][:90], None, "s2", 1) for i in range(30)]
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0), (702, "long " * 3000, "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, y) for d, _, _, y in base], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, base


def test_stages(spark, tables):
    path, base = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    schema, kept = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, path))
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in schema]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {d for d, _, _, y in base if y}
    assert len(toxic & kept["toxicity"].keys()) <= 3 and len({d for d, *_ in base} - toxic - kept["toxicity"].keys()) <= 3
    rows = [(r.doc_id, r.text) for r in kept["toxicity"].values()]
    assert kept["exact_dedup"].keys() == {k for k, _ in exact_brute(rows).values()}
    sets = {d: shingles(r.text) for d, r in kept["exact_dedup"].items()}
    component = slow_components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert kept["simhash_near_dedup"].keys() == set(component.values())
    want = suffix_brute([(d, r.text) for d, r in kept["simhash_near_dedup"].items()], 50)
    assert {d: r.text.encode() for d, r in kept["suffix_array_dedup"].items()} == {d: b for d, *_, b in want}
    assert all(r[2:] == kept["toxicity"][d][2:] for d, r in kept["suffix_array_dedup"].items())
    library = Tokenizer.from_file(VOCABULARY)
    ids = {d: library.encode(r.text, add_special_tokens=False).ids + [0] for d, r in kept["suffix_array_dedup"].items()}
    packed = corpus_pipeline.pack(spark, docs, path).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in packed) == sorted(
        (d, a, zlib.crc32(np.array(x[a : a + 2048], "<u4").tobytes())) for d, x in ids.items() for a in range(0, len(x), 2048)
    )
    assert len({r.sequence_id for r in packed}) == -(-sum(map(len, ids.values())) // 2048)


def test_run_is_the_stages(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 100
