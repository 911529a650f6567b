import re
from collections import Counter

import public_tokenizers

from marketframe.llm import fertility as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def base(text):
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_measures_and_bands(docs_of, prose):
    pairs = [(k, prose(120 + k % 9, k)) for k in range(150)]
    junk = [(1000 + k, "".join(f"{w}{'*#$%'[k % 4] * 9} " for w in prose(120, 700 + k).split())) for k in range(5)]
    odd = [(2000, ""), (2001, None), (2002, "short é text"), (2003, "a b c d e " * 8), (2004, "x\ny\nx\n \n \nx"),
           (2005, prose(20000, 9)), (7, prose(120, 7)), (2006, "日本語の文章です。" * 40)]
    rows = Q.judge(docs_of(pairs + junk + odd), *PATHS).collect()
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                  r["base_failed"]) for r in rows)
    assert got == sorted((i, *base(t or "")) for i, t in pairs + junk + odd)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert sum(kept[i] for i, _ in pairs) >= 149 and not any(kept[i] for i, _ in junk)
    assert not kept[2000] and not kept[2001] and not kept[2003]
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)


def test_short_junk(docs_of, prose):
    """Texts of few tokens are judged, too."""
    pairs = [(k, prose(30 + k % 200, k)) for k in range(150)]
    short = [(1000 + k, " ".join(chr(0x12000 + 11 * k + j) for j in range(10))) for k in range(3)]
    rows = {r["doc_id"]: r for r in Q.judge(docs_of(pairs + short), *PATHS).collect()}
    assert all(rows[i]["n_tokens"] < 64 and not rows[i]["base_failed"] and not rows[i]["kept"] for i, _ in short)
    assert sum(rows[i]["kept"] for i, _ in pairs) >= 145


def test_labelled_junk(spark):
    """Labelled texts that pass the base rules: most junk goes, good ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = Q.judge(docs, *PATHS).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = Counter({(r["quality"], r["kept"]): r["count"] for r in rows})
    print("LABELS", dict(n))
    assert n[0, False] >= 0.75 * (n[0, False] + n[0, True])
    assert n[1, False] <= 0.01 * (n[1, False] + n[1, True])


def test_empty_table_and_scripts(spark, docs_of):
    assert Q.judge(docs_of([]), *PATHS).count() == 0
    rows = spark.createDataFrame([("de", "x"), (None, "привет мир"), ("", "hello"), (None, None)], "lang string, text string")
    got = [r[0] for r in rows.select(Q.group_of(rows.lang, rows.text)).collect()]
    assert got == ["de", "script:cyrillic", "script:latin", "script:latin"]
