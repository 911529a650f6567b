import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from marketframe.llm.common import materialise


@pytest.fixture(scope="module")
def tables(spark, prose, tmp_path_factory):
    """documents, labels and benchmark with known copies, leaks and toxic texts."""
    d = str(tmp_path_factory.mktemp("tables"))
    item = prose(40, 7007)
    rows = [(k, prose(60, k)) for k in range(120)]
    rows += [(200 + k, prose(50, 200 + k) + " scumbag morons " + prose(9, k)) for k in range(40)]
    rows += [(300, prose(30, 9) + " " + item + " " + prose(30, 8))]
    rows += [(400 + k, rows[k][1] + " changed tail") for k in range(10)] + [(500, ""), (501, None)]
    docs = [(i, t, "en", "s", len(t or ""), "extra") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"
                          ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 240)) for i, _ in rows if i < 240], "doc_id long, toxic int"
                          ).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(30, 7077))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_decisions_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, tables))
        assert docs.columns == columns, name
        assert {r["score"] for r in docs.select("score").collect()} == {"extra"}
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = {*range(120), 300, *range(400, 410), 500, 501}
    assert kept[0] == everything                     # the toxic ones went
    assert kept[1] == everything                     # lines go, documents stay
    assert kept[2] == everything - set(range(400, 410))
    assert kept[3] == kept[2] - {300}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    for r in docs.collect():
        own = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in own]).tolist()
        assert ids == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]


def test_empty_documents(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, tables))
        assert docs.count() == 0


def test_every_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
