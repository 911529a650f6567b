import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketframe.sources.feed_split import _cut, read_feed_split
from marketframe.sources.tables import read_feed

NASTY = ["}", "{", '"', "\\", '\\"', "}]}", '{"data":[{', ",", "ñ", "龍", "\n", " ", "[", "]", "a", '"}']


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _cards(rng, n, first=0):
    def text():
        return "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 12)))
    for i in range(first, first + n):
        card = {"id": i, "name": text(), "desc": text() * rng.choice([1, 1, 40]), "atk": rng.choice([None, 0, 100])}
        if rng.random() < 0.7:
            card["card_sets"] = [{"set_name": text(), "set_code": text(), "set_price": "1"}
                                 for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.5:
            card |= {"typeline": [text() for _ in range(rng.randint(0, 3))], "banlist_info": {"ban_ocg": text()},
                     "extra": {"deep": [{"er": [{}, [[]]]}]}}
        yield card


def _rows(df):
    return sorted(tuple(r) for r in df.select(F.to_json(F.struct("*"))).collect())


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 2), (3, None)])
def test_equals_whole_document_read(spark, scratch_dir, small_splits, seed, indent):
    """One large document and small ones, with braces, quotes and escapes in texts."""
    rng = random.Random(seed)
    documents = [list(_cards(rng, 200)), list(_cards(rng, 1, 200)), [], list(_cards(rng, 9, 300))]
    for i, cards in enumerate(documents):
        with open(f"{scratch_dir}/feed-{i}.json", "w", encoding="utf-8") as f:
            json.dump({"data": cards}, f, indent=indent, ensure_ascii=rng.random() < 0.5)
            f.write(rng.choice(["", "\n"]))
    with open(f"{scratch_dir}/feed-null.json", "w") as f:
        f.write('{"data": null}\n')
    open(f"{scratch_dir}/feed-empty.json", "w").close()
    got = read_feed_split(spark, scratch_dir)
    want = read_feed(spark, scratch_dir)
    assert got.schema == want.schema
    assert _rows(got) == _rows(want) and got.count() == 210


def test_one_document_uses_many_tasks(spark, scratch_dir, small_splits):
    with open(f"{scratch_dir}/feed.json", "w") as f:
        json.dump({"data": list(_cards(random.Random(5), 300))}, f)
    assert read_feed(spark, scratch_dir).rdd.getNumPartitions() == 1
    text = spark.read.option("lineSep", "}").text(scratch_dir)
    assert text.rdd.getNumPartitions() > 8
    assert read_feed_split(spark, scratch_dir).select("id").distinct().count() == 300


@pytest.mark.parametrize("text", [
    '{"meta": {"n": {"a": 1}}, "data": [{"id": 1}]}',      # another member
    '[{"id": 1}]',                                         # no document around the cards
    '{"data": [{"id": 1}, {"id": 2, "name": "cut o',       # cut off in a card
    '{"data": [{"id": 1} {"id": 2}]}',                     # no comma
    '{"data": [{"id": "one"]}, {"id": 2}]}',               # unbalanced
])
def test_other_documents_fail(spark, scratch_dir, text):
    with open(f"{scratch_dir}/feed.json", "w") as f:
        f.write(text)
    with pytest.raises(Exception, match="not a card|MALFORMED|Malformed"):
        read_feed_split(spark, scratch_dir).collect()


def test_cut_holds_one_batch_at_a_time(spark):
    """A piece comes as records; what a batch gives out is what it got, and the
    state goes on from one batch to the next."""
    text = json.dumps({"data": list(_cards(random.Random(7), 60))}, ensure_ascii=False)
    records = text.split("}")[:-1]
    pdf = pd.DataFrame({"file": "f", "block": 0, "piece": 3, "in_string": 0, "depth": 0, "card": 10,
                        "at": range(len(records)), "record": records})
    batches = [pdf[i:i + 8] for i in range(0, len(pdf), 8)]
    got = list(_cut(iter(batches)))
    assert len(got) == len(batches) > 20
    assert [g["text"].str.cat() for g in got] == ["}".join(b["record"]) + "}" for b in batches]
    whole = pd.concat(got).groupby("card", sort=True)["text"].sum().tolist()
    cards = [json.loads(t.removeprefix('{"data": [').removeprefix(", ")) for t in whole[:-1]]
    assert cards == json.loads(text)["data"] and whole[-1] == "]}"
