import re

from marketframe.llm import line_dedup as L

BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def words(line):
    return [w for w in BLANK.split(line.lower()) if w]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) > 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(pairs):
    earlier, out = [], {}
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, lines = [], t.split("\n")
        for line in lines:
            w = words(line)
            # a row without an id takes part with its equal lines only
            gone = bool(w) and any(w == e or (named and i is not None and min(len(w), len(e)) >= L.MIN_WORDS
                                              and one_edit(w, e)) for e, named in earlier)
            if w:
                earlier.append((w, i is not None))
            if not gone:
                kept.append(line)
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_equals_brute_force(docs_of, prose):
    base = [prose(n, n) for n in (8, 9, 12, 16, 17, 31, 33)]
    lines = list(base)
    for k, b in enumerate(base):
        w = b.split(" ")
        lines += [" ".join(w[:-1]), " ".join(w[1:]), " ".join(w + ["more"]), " ".join(["x", *w[1:]]),
                  " ".join(w[:4] + ["mid"] + w[4:]), " ".join(w[:4] + ["alt"] + w[5:]), b.upper(), f"  {b} \t",
                  " ".join(["x", *w[1:-1], "y"])]
    lines += ["short line", "Short  line", "short lime", "", "", " ", "ok", "ok"]
    pairs = [(100 - k, "\n".join(lines[k::5])) for k in range(5)]
    pairs += [(200 + k, prose(20, 500 + k) + "\n" + base[k % 3]) for k in range(20)]
    pairs += [(300, None), (301, ""), (302, "\n\n"), (303, prose(20000, 5)), (304, prose(20000, 5) + " tail")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(docs_of(pairs)).collect()}
    assert got == brute(pairs)


def test_rows_without_an_id(docs_of, prose):
    one, two = prose(12, 1).split(" "), prose(20, 2).split(" ")
    pairs = [(None, " ".join(one) + "\n" + " ".join(two[:-1])), (2, " ".join(one)), (5, " ".join([*one[:4], "x", *one[5:]])),
             (6, " ".join([*one[:7], "y", *one[8:]]) + "\nown line"), (7, " ".join(two)), (8, " ".join([*two, "z"]))]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(docs_of(pairs)).collect()}
    assert got == brute(pairs)
    assert got[2][2] == got[5][2] == got[6][2] == got[8][2] == 1 and got[7][2] == got[None][2] == 0


def test_long_lines(docs_of, prose):
    words = prose(60_000, 3).split(" ")
    pairs = [(1, " ".join(words)), (2, " ".join([*words[:40_000], "x", *words[40_001:]])), (3, " ".join(words[1:])),
             (4, " ".join([*words[:100], "x", *words[101:50_000], "y", *words[50_001:]]))]
    got = {r["doc_id"]: r["n_removed"] for r in L.dedup_lines(docs_of(pairs)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_empty_table_and_columns(docs_of):
    docs = docs_of([])
    out = L.dedup_lines(docs)
    assert out.count() == 0
    assert set(docs.columns) <= set(out.columns)


def test_no_python_in_the_plan(docs_of):
    plan = L.dedup_lines(docs_of([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_lines_are_normalised_once(spark):
    """The check's op9 figure: no condition repeats the normal form."""
    import contextlib
    import io
    docs = spark.createDataFrame([(1, "A b  c\n \n\n\t\nx"), (2, None), (3, "")], "doc_id long, text string")
    rows = L._places(docs, "doc_id", "text")
    assert sorted((r.at.doc_id, r.at.place, r.line, r.n_words) for r in rows.collect()) == [(1, 0, "a b c", 3), (1, 4, "x", 1)]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        rows.explain()
    assert not any("lower(" in x for x in out.getvalue().splitlines() if "Filter" in x)
