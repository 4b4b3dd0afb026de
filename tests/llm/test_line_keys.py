"""Band keys and parity bitmaps of line dedup, on pairs of random sets at Jaccard 0.8."""

import numpy as np
import pytest

from riselens.llm import line_dedup


@pytest.mark.parametrize("union", [10, 40, 90, 130, 260, 500])
def test_pairs_share_a_key_and_no_bitmap_rules_them_out(union):
    rng, same, pairs = np.random.default_rng(union), int(np.ceil(0.8 * union)), 1000
    sets = []
    for _ in range(pairs):
        values = rng.permutation(np.unique(rng.integers(0, 2**44, union)))
        half = same + (union - same) // 2
        sets += [np.sort(values[:half]), np.sort(np.concatenate((values[:same], values[half:])))]
    n = np.array([len(s) for s in sets])
    values, ends = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)))
    keys, at = line_dedup.band_keys(values, ends)
    of = [set(keys[lo:hi].tolist()) for lo, hi in zip(at[:-1], at[1:])]
    assert sum(bool(a & b) for a, b in zip(of[::2], of[1::2])) >= 0.99 * pairs
    bits = line_dedup.parity(values, ends)
    differ = np.bitwise_count((bits[::2] ^ bits[1::2]).view(np.uint64)).sum(1).astype(int)
    assert (9 * differ <= n[::2] + n[1::2]).all()
    for s, words in zip(sets[:50], bits[:50]):
        counts = np.bincount(s % (64 * line_dedup.WORDS), minlength=64 * line_dedup.WORDS) % 2
        assert (np.unpackbits(words.view(np.uint8), bitorder="little") == counts).all()


def test_two_common_shingles_make_no_list_of_short_lines():
    """Short lines that agree in their two smallest hashes alone share no neighbour key."""
    rng = np.random.default_rng(1)
    common = np.array([2**41, 2**41 + 1])  # in the same range: no band holds four values of these alone
    sets = [np.concatenate((common, np.sort(rng.integers(2**42, 2**44, 20)))) for _ in range(200)]
    keys, at = line_dedup.band_keys(np.concatenate(sets), np.arange(len(sets) + 1) * 22)
    own = np.concatenate([keys[lo + line_dedup.BANDS : hi] for lo, hi in zip(at[:-1], at[1:])])
    assert len(own) > len(sets) and len(np.unique(own)) == len(own)


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_tiny_sets_keep_their_pairs_as_keys(n):
    """Sets of n and n + 1 shingles, the one within the other, share a key wherever that is Jaccard 0.8."""
    rng = np.random.default_rng(n)
    for _ in range(200):
        whole = np.sort(rng.integers(0, 2**44, n + 1))
        part = np.delete(whole, rng.integers(n + 1))
        keys, at = line_dedup.band_keys(np.concatenate((whole, part)), np.array([0, n + 1, 2 * n + 1]))
        assert 100 * n < 80 * (n + 1) or set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_entries_are_dealt_by_key_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    reps = spark.range(1000).selectExpr("id", "id % 7 + 20 as n", "array(id div 3, id + 5000) as keys")
    shared = line_dedup._shared(reps)
    try:
        assert shared.collect()
        plan = shared._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning(key" in x and "Reused" not in x]) == 1


def test_long_lists_are_compared_by_a_join(spark, monkeypatch):
    """A list over LIST lines and up to LONG gives its links without blocks in Python tasks."""
    words = [f"word{i:02d}" for i in range(40)]
    docs = [(i, " ".join(words[:30] + [f"own{i:03d}{k}" for k in range(8)])) for i in range(30)]
    docs += [(100 + i, f"{t}!") for i, t in docs]
    monkeypatch.setattr(line_dedup, "LIST", 2)
    tiled = []
    monkeypatch.setattr(line_dedup, "_tiles", lambda rows, *a, run=line_dedup._tiles: tiled.append(rows.count()) or run(rows, *a))
    rows = line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.first_doc_id for r in rows if r.doc_id >= 100} <= set(range(30))
    assert sum(tiled) == 0


def test_equal_lines_collapse_before_their_sets_are_built(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_dedup, "with_keys", lambda lines, run=line_dedup.with_keys: seen.append(lines.count()) or run(lines))
    docs = [(i, f"one line that every document has\nand one of number {i} alone") for i in range(20)]
    rows = line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert seen == [21] and len(rows) == 40
    assert {(r.first_doc_id, r.kept) for r in rows if r.line_no == 0} == {(0, True), (0, False)}


def test_lists_are_looked_up_without_sorting_the_entries(spark):
    reps = spark.range(1000).selectExpr("id", "id % 7 + 20 as n", "array(id div 3, id + 5000) as keys")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = line_dedup._shared(reps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan


@pytest.mark.parametrize("text", ["a", "abcd", "abcde", "abcdefgh", "日本語", "né à 日本語 🙂🙂"])
def test_shingles_at_every_character(text):
    """Lines end to end have the sets that they have alone, one for each distinct window."""
    whole = [text, "in between", text + text]
    raw = [t.encode() for t in whole]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    values, ends = line_dedup.shingles(np.frombuffer(b"".join(raw), np.uint8), bounds)
    for k, t in enumerate(whole):
        alone, _ = line_dedup.shingles(np.frombuffer(raw[k], np.uint8), np.array([0, len(raw[k])]))
        assert (values[ends[k] : ends[k + 1]] == alone).all()
        assert len(alone) == len({t[i : i + line_dedup.Q] for i in range(len(t))})


def test_a_list_of_two_is_a_pair_without_a_join(spark):
    """Its pivot and the other line; the pivot's own entry is not looked for."""
    shared = spark.createDataFrame([(7, 2, 20, 2, 1), (8, 3, 20, 3, 1), (8, 1, 20, 3, 1), (8, 4, 20, 3, 1)], "key long, id long, n int, c long, pivot long")
    bits = [0] * line_dedup.WORDS
    reps = spark.createDataFrame([(i, 20, bits) for i in range(1, 5)], "id long, n int, bits array<long>")
    pairs = {(r.a, r.b) for r in line_dedup._pairs(shared, reps).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (3, 4)}
