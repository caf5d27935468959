"""Bulk-synchronous best fit against a sequential one."""

import bisect
import random

import pytest

from channel_signals.llm import packing

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sequential(lengths, capacity):
    """Sequences that best fit opens when documents come by falling length."""
    gaps, opened = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        opened += gap == capacity
        if gap > x:
            bisect.insort(gaps, gap - x)
    return opened


def packed(spark, lengths, capacity):
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, PIECES).repartition(3), capacity).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == [(i, n) for i, n, in enumerate(lengths)]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def lengths_of(kind, n, rng):
    return {
        "even": lambda: [rng.randint(1, 100) for _ in range(n)],
        "short": lambda: [rng.randint(1, 9) for _ in range(n)],
        "one": lambda: [1] * n,
        "hot": lambda: [34] * (n // 2) + [rng.randint(1, 100) for _ in range(n // 2)],
        "full": lambda: [100] * n + [50, 50, 51],
    }[kind]()


@pytest.mark.parametrize("rows", [50_000, 60])
@pytest.mark.parametrize("kind", ["even", "short", "one", "hot", "full"])
def test_few_sequences_in_few_rounds(spark, monkeypatch, rows, kind):
    """One range, or as many as the session deals."""
    monkeypatch.setattr(packing, "RANGE_ROWS", rows)
    lengths = lengths_of(kind, 400, random.Random(4))
    rounds = []
    swept = packing._swept
    monkeypatch.setattr(packing, "_swept", lambda *a: rounds.append(a[2]) or swept(*a))
    got = packed(spark, lengths, 100)
    want = sequential(lengths, 100)
    assert -(-sum(lengths) // 100) <= got <= want + (0 if rows > 1000 else 1 + want // 25)
    assert len(rounds) <= 12
    assert (max(rounds, default=1) == 1) == (rows > 1000 or kind == "full")


def test_a_sweep_takes_successors():
    rows = [(False, 90, "a", 10, "-"), (False, 70, "b", 30, "-"), (True, 60, None, None, "x"), (True, 30, None, None, "y"),
            (True, 30, None, None, "z"), (False, 10, "c", 0, "-"), (True, 10, None, None, "w")]
    got = list(packing._sweep(iter(rows)))
    # x takes b, the smaller gap; y and z share a; w takes b's last ten before c's
    assert [(r[3], r[4], r[5]) for r in got if r[0] == packing._PLACED] == [
        ("b", 30, "x"), ("a", 10, "y"), ("a", 40, "z"), ("c", 0, "w")]
    assert [(r[2], r[3]) for r in got if r[0] == packing._GAP] == [(10, "b"), (30, "a")]


def test_leftovers_meet_free_gaps_by_rank():
    found = [{"part": 0, "kind": packing._GAP, "n": 2, "low": 100, "high": 100},
             {"part": 1, "kind": packing._DOC, "n": 5, "low": 20, "high": 40},
             {"part": 1, "kind": packing._GAP, "n": 1, "low": 30, "high": 30},
             {"part": 2, "kind": packing._DOC, "n": 3, "low": 5, "high": 15}]
    # two of at most 40 fit 100, and two of at most 15 fit 30; a fifth goes without
    assert packing._segments(found) == [(1, 0, 4, 0, 0, 2), (2, 0, 2, 1, 0, 2)]
    found[1]["n"] = 3
    # a gap that a larger range has begun serves the next one from what is surely left
    assert packing._segments(found)[:2] == [(1, 0, 3, 0, 0, 2), (2, 0, 2, 1, 0, 2)]
    assert packing._segments(found)[2:] == [(2, 2, 3, 0, 1, 4)]
