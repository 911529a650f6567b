import random

import pytest

from marketframe.operators import tournaments as tn
import replay

T = "id long, name string, participants int, maxPlayers string"
P = "name string, konamiid string, idtournament long, victory int, defeat int, draw int"
J = "seq long, konamiid string, name string, idtournament long"


@pytest.mark.parametrize("seed", [31, 32, 33, 34])
def test_admission_equals_sequential_replay(spark, seed):
    rng = random.Random(seed)
    tours = {}
    for tid in range(6):
        tours[tid] = dict(participants=rng.choice([None, 0, 2, 5, 9]),
                          maxPlayers=rng.choice(["3", "5", "8", "sin limite", None, "4x"]))
    players = {tid: rng.randint(0, 4) for tid in range(6) if rng.random() < 0.5}
    joins = [(seq, rng.choice([0, 1, 2, 3, 4, 5, 77])) for seq in range(80)]
    rng.shuffle(joins)  # arrival order is seq, not row order
    want, final = replay.admission(tours, players, sorted(joins))
    t_df = spark.createDataFrame([(k, f"T{k}", v["participants"], v["maxPlayers"]) for k, v in tours.items()], T)
    p_df = spark.createDataFrame([(f"p{k}{i}", f"K{k}{i}", k, None, None, None)
                                  for k, n in players.items() for i in range(n)], P)
    j_df = spark.createDataFrame([(s, f"KID{s}", f"n{s}", tid) for s, tid in joins], J)
    out = tn.admit_players(t_df, p_df, j_df)
    assert sorted((r.seq, r.outcome) for r in out.collect()) == sorted(want)
    new_t, new_p = tn.apply_admissions(t_df, p_df, out)
    assert {r.id: r.participants for r in new_t.collect()} == {k: v["participants"] for k, v in final.items()}
    assert new_p.count() == p_df.count() + sum(1 for _, o in want if o == "ok")
    counts = {r.idtournament: r.participants for r in tn.player_counts(new_p).collect()}
    for k, v in final.items():
        if any(o == "ok" for s, o in want if dict(joins)[s] == k):
            assert counts[k] == v["participants"]


def test_set_results(spark):
    p = spark.createDataFrame([("a", "K1", 1, None, None, None), ("b", "K2", 1, 1, 1, 1)], P)
    r = spark.createDataFrame([("K2", 1, 3, None, 0), ("K9", 1, 1, 1, 1)],
                              "konamiid string, idtournament long, victory int, defeat int, draw int")
    got = sorted(tuple(x) for x in tn.set_results(p, r).new_state.collect())
    assert got == [("a", "K1", 1, None, None, None), ("b", "K2", 1, 3, None, 0)]
