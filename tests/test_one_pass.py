"""Jobs that make their rows once, and an exact way for large keys."""

from __future__ import annotations

from folioframe.operators import grids


def test_reflowed_tables_are_not_made_again_for_a_join(spark, capsys):
    cells = spark.createDataFrame([(1, 0, 0, "a", 1, 1), (1, 1, 0, "b", 1, 1)], "tab int, row int, place int, text string, rowspan int, colspan int")
    got = grids.reflowed(cells, "tab")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, "a"), (1, 1, 0, "b")]
    got.explain()
    plan = capsys.readouterr().out
    assert not [op for op in ("HashJoin", "MergeJoin", "+- Union") if op in plan]


def test_short_texts_of_large_keys_are_linked_as_all_pairs_are(spark):
    """150 sets of 20 of 40 shingles, each with a near one: all keys are larger than 12, and the groups are those of brute force."""
    import numpy as np

    from folioframe.llm import near_texts as N

    r = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        base = r.choice(40, 20, replace=False).tolist()
        sets += [sorted(base), sorted([*base[1:], int(r.choice([x for x in range(40) if x not in base]))])]
    sets = [list(x) for x in {tuple(x) for x in sets}]
    rows = spark.createDataFrame([(bytes([k >> 8, k & 255]), x) for k, x in enumerate(sets)], "fp binary, shingles array<long>")

    def groups(pairs):
        top = list(range(len(sets)))
        for _ in top:
            for a, b in pairs:
                top[a] = top[b] = min(top[a], top[b])
        return top

    want = [(a, b) for a in range(len(sets)) for b in range(a) if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    got = [(int.from_bytes(x.a), int.from_bytes(x.b)) for x in N.short_links(rows, largest=12).collect()]
    assert {tuple(sorted(x)) for x in got} <= {tuple(sorted(x)) for x in want}
    assert groups(got) == groups(want)
