"""Groups of the packing stay bounded, whatever the lengths and ids."""

from __future__ import annotations

import collections

from retentio.llm import packing


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(spark, monkeypatch, rows, shard_pieces, capacity=100):
    """Rows packed, and the largest group of each round."""
    groups, real = [], packing._packed

    def watched(items, *rest):
        out = packing.frozen(real(items, *rest))
        groups.append(max(collections.Counter(x.bin >> 32 for x in out.collect()).values()))
        return out

    monkeypatch.setattr(packing, "_packed", watched)
    out = packing.best_fit_decreasing(packing.frozen(table(spark, rows)), capacity, shard_pieces).collect()
    assert sorted((x.doc_id or -1, x.piece, x.ids_crc32) for x in out) == sorted((x[0] or -1, x[1], x[4]) for x in rows)
    by_bin = collections.defaultdict(list)
    for x in out:
        by_bin[x.sequence_id].append((x.offset, x.length))
    for places in by_bin.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= capacity
    return by_bin, groups


def test_sequences_that_cannot_combine_stay_in_bounded_groups(spark, monkeypatch):
    rows = [(i, 0, 0, 51 + i % 40, i) for i in range(1500)]
    by_bin, groups = packed(spark, monkeypatch, rows, shard_pieces=50)
    assert len(by_bin) == 1500 and max(groups) < 150


def test_a_few_that_combine_do_not_gather_the_others(spark, monkeypatch):
    rows = [(i, 0, 0, 60, i) for i in range(1000)] + [(2000 + i, 0, 0, 30, i) for i in range(25)]
    by_bin, groups = packed(spark, monkeypatch, rows, shard_pieces=50)
    assert len(by_bin) == 1000 and max(groups) < 150


def test_one_id_on_many_rows_is_dealt_out(spark, monkeypatch):
    for rows in ([(None, 0, 0, 70, i) for i in range(1000)], [(None, 0, 0, 70, 1)] * 1000, [(3, 0, 0, 70, 1)] * 1000):
        _, groups = packed(spark, monkeypatch, rows, shard_pieces=50)
        assert max(groups) < 150
        monkeypatch.undo()
