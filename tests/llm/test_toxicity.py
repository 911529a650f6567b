import random

from marketframe.llm import toxicity as T


def corpus(prose, n=240):
    r, rows = random.Random(5), []
    for k in range(n):
        words = prose(r.randint(30, 90), 1000 + k).split(" ")
        toxic = k % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                words[r.randrange(len(words))] = r.choice(["scumbag", "morons", "vileaco", "vileoso", "vileando"])
        elif k % 8 == 1:  # a lexicon word in a harmless phrase
            at = r.randrange(len(words) - 1)
            words[at:at + 2] = ["scumbag", "detector"]
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def learned(spark, prose):
    rows = corpus(prose)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (10 ** 6, 1)],
                                   "doc_id long, toxic int")
    return rows, docs, T.learn(docs, labels.where(T.remainder() != 0))


def test_held_out_accuracy_folding_and_exceptions(spark, prose):
    rows, docs, lexicon = learned(spark, prose)
    truth = {r[0]: r[2] for r in rows}
    got = {r["doc_id"]: r for r in T.score(docs, lexicon).collect()}
    assert sum(got[i]["predicted"] == t for i, t in truth.items()) >= 0.97 * len(truth)
    plain = prose(40, 1)
    cases = [plain, plain + " SCUMBAG morons", plain + " ѕсumb@g m0r0ns", plain + " scumbag detector",
             plain + " viIeanything vileother", "", None, "scumbag " * 20000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in T.score(docs, lexicon).collect()}
    assert [out[k]["predicted"] for k in range(8)] == [0, 1, 1, 0, 1, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_fold():
    assert T.fold("Ìd1öt — ТRASH!").split() == ["idiot", "trash"]
    assert T.fold("scum! m0r0ns. a$$ @ss v!le|y !no |yes| 5 stars, 2019! дум").split() == [
        "scum", "morons", "ass", "ass", "viieiy", "no", "yes", "stars", "дyм".replace("м", "m")]
    assert T.fold("ѕсum, бad б").split() == ["scum", "bad", "b"]
    assert T.fold("a​b") == " ab "
    assert T.fold(None) == T.fold("") == ""


def test_matches_equal_naive_search(spark, prose):
    """The automaton against looking every word up, with long neighbours."""
    entries = {" scum ": 4.0, " scumb": 5.0, " mor": 3.0, " morons ": 6.0, " ass ": 2.0, " viie": 1.5}
    lexicon = T.Lexicon(entries, frozenset(["scum detector", "x" * 200 + " morons", "ass " + "y" * 90]), (-2.0, 1.0, 1.0))
    automaton = lexicon.automaton()

    def naive(text):
        words, weight, n = T.fold(text).split(), 0.0, 0
        for k, w in enumerate(words):
            held = [e for e in entries if (f" {w} " == e) or (not e.endswith(" ") and f" {w}".startswith(e))]
            near = {f"{a} {b}" for a, b in zip(words[max(0, k - 1):k + 1], words[max(0, k - 1) + 1:k + 2])}
            if held and not near & lexicon.exceptions:
                weight, n = weight + entries[max(held, key=len)], n + 1
        return weight, n, len(words)
    r = random.Random(4)
    parts = ["scum!", "SCUMBAG", "scum", "detector", "m0r0ns.", "morons", "x" * 200, "a$$", "y" * 90, "ѕсum", "v!le", "moron!",
             "-", "ok", "mor", "scummy"]
    for _ in range(500):
        text = " ".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert lexicon.measure(text, automaton) == naive(text), text
    assert lexicon.measure("scum!", automaton)[1] == 1


def test_extra_columns_empty_tables_and_no_labels(spark, docs_of, prose):
    docs = docs_of([(1, "some text"), (1, "some text"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = T.learn(docs, none)
    rows = T.score(docs, lexicon).collect()
    assert [r["score"] for r in rows] == [0.0] * 3 and {r["host"] for r in rows} == {"x"}
    assert T.score(docs_of([]), lexicon).count() == 0
    assert T.learn(docs_of([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).curve is None
