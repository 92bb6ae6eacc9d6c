"""Which windows of a fixed length occur in an earlier document, over all documents.

A window is `length` consecutive units (bytes or words) of one document.  Each window
is represented by its minimizer: the position of the smallest hash among the
`seed`-unit strings inside it.  Equal windows have the same minimizer at the same
place, so all copies of a window meet under one key, the hash of the seed string.
Consecutive windows with one minimizer make a *stretch*; about one stretch stands for
seventeen byte windows.

Round 1 sends, of each stretch, the key, a hash of its whole content and its document.
Spark deals them by key.  A key met once is done: none of its windows can repeat.  If
all stretches under a key are equal, the first document owns them and the others are
covered.  Only where different stretches share a key are windows compared one by one:
round 2 deals these windows by the hash of their content.

A pack sends one entry a key in round 1 (several different stretches are one mark) and one
entry a window in round 2, with the smallest document that has it: a key has at most as many
entries as there are packs.  A line that stands in every pack therefore has an entry from
each in one group, which grows with the number of packs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from airloom.llm.arrays import U64, Rolling, mixed, sliding_min, window_starts
from airloom.llm.packs import ANSWERS, MESSAGES, Pack, answered, bucket_count, bucket_of, sent, unpacked
from airloom.sources.scratch import written

COVERED, COMPARE = 1, 2
#: Sent instead of a content hash by a pack that has several stretches under a key.
SEVERAL = U64(0xFFFFFFFFFFFF)
_LOW32 = U64(0xFFFFFFFF)
_HIGH32 = U64(0xFFFFFFFF00000000)


@dataclass
class Stretches:
    """Stretches of a pack, ordered by key, content, document id and place; `first`
    marks the first of equal ones."""

    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    low: np.ndarray
    count: np.ndarray
    first: np.ndarray
    rolling: Rolling | None


def stretches(values: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int, seed: int) -> Stretches:
    at = window_starts(offsets, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Stretches(none.astype(U64), none.astype(U64), none, none, none, none.astype(bool), None)
    rolling = Rolling(values)
    grams = rolling.every(seed)
    spots = (grams & _HIGH32) | np.arange(len(grams), dtype=U64)
    best = (sliding_min(spots, length - seed + 1)[at] & _LOW32).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(best) != 0) | (np.diff(at) != 1)) + 1, [len(at)]])
    low, count, place = at[cuts[:-1]], np.diff(cuts), best[cuts[:-1]]
    content = (rolling.of(low, low + count - 1 + length) ^ mixed((count * (length + 1) + place - low).astype(U64))) & U64(0xFFFFFFFFFFFF)
    key = grams[place]
    doc = np.searchsorted(offsets, low, "right") - 1
    order = np.argsort(ids[doc], kind="stable")
    order = order[np.lexsort((content[order], key[order]))]
    key, content = key[order], content[order]
    first = np.ones(len(order), bool)
    first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    return Stretches(key, content, doc[order], low[order], count[order], first, rolling)


def _ids_out(ids: np.ndarray) -> bytes:
    """Document ids as distances from the smallest, in the width that they need."""
    base = int(ids.min())
    far = ids.astype(np.uint64) - np.uint64(base % (1 << 64))
    width = 2 if far.max() < 1 << 16 else 4 if far.max() < 1 << 32 else 8
    return np.int64(base).tobytes() + np.int64(width).tobytes() + far.astype(f"u{width}").tobytes()


def _ids_in(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    base, width = np.frombuffer(raw, np.int64, 2)
    return (np.frombuffer(raw, f"u{width}", n, 16).astype(np.uint64) + np.uint64(int(base) % (1 << 64))).astype(np.int64), 16 + int(width) * n


def _six(x: np.ndarray) -> bytes:
    return (x & _LOW32).astype(np.uint32).tobytes() + (x >> U64(32)).astype(np.uint16).tobytes()


def _six_in(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32, n, at).astype(U64) | (np.frombuffer(raw, np.uint16, n, at + 4 * n).astype(U64) << U64(32))


def _slices(key: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    if not len(key):
        return []
    of = bucket_of(key, buckets)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    return [(int(of[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def _key_groups(s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Over the first ones of equal stretches: where a new key begins, and the key's number."""
    key = s.key[s.first]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _first_messages(s: Stretches, pack: Pack, buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry a key: its only stretch in this pack, or the mark that it has several."""
    starts, number = _key_groups(s)
    key, content, ids = s.key[s.first][starts], s.content[s.first][starts].copy(), pack.ids[s.doc[s.first]][starts]
    content[np.bincount(number, minlength=len(starts)) > 1] = SEVERAL
    rows = []
    for bucket, a, b in _slices(key, buckets):
        raw = np.int64(b - a).tobytes() + _ids_out(ids[a:b]) + (key[a:b] & _LOW32).astype(np.uint32).tobytes() + _six(content[a:b])
        rows.append((bucket, pack.number, raw))
    if rows:
        yield sent(rows)


def _answer(bucket: int, packs: list[int], codes: np.ndarray, sizes: list[int]) -> pa.Table:
    rows, at = [], 0
    for pack, n in zip(packs, sizes):
        mine = codes[at : at + n]
        at += n
        if mine.any():
            rows.append((pack, bucket, mine.tobytes()))
    p, b, c = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(p, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["pack", "bucket", "answer"])


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Starts of the groups of equal keys, along `order`."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return new


def _first_answers(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys, contents, ids, sizes = [], [], [], []
    for r in rows:
        raw = r["keys"]
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        got, used = _ids_in(raw[8:], n)
        at = 8 + used
        ids.append(got)
        keys.append(np.frombuffer(raw, np.uint32, n, at).astype(U64))
        contents.append(_six_in(raw, n, at + 4 * n))
        sizes.append(n)
    key, content, doc = np.concatenate(keys), np.concatenate(contents), np.concatenate(ids)
    order = np.lexsort((content, key))
    fresh = _groups(order, key, content)
    by_key = np.cumsum(_groups(order, key)) - 1
    several = content[order] == SEVERAL
    different = (np.bincount(by_key, weights=fresh)[by_key] > 1) & ~several
    starts = np.flatnonzero(fresh)
    least = np.minimum.reduceat(doc[order], starts)[np.cumsum(fresh) - 1]
    later = (doc[order] > least) & ~several
    codes = np.zeros(len(order), np.uint8)
    codes[order] = np.where(later, COVERED, np.where(different, COMPARE, 0))
    return _answer(rows[0]["bucket"], [r["pack"] for r in rows], codes, sizes)


def _codes(s: Stretches, answers: dict[int, list[bytes]], buckets: int) -> np.ndarray:
    """What is to be done with each first stretch of a pack, in its order."""
    starts, number = _key_groups(s)
    out = np.zeros(len(starts), np.uint8)
    if answers:
        for bucket, a, b in _slices(s.key[s.first][starts], buckets):
            for got in answers.get(bucket, ()):
                out[a:b] = np.frombuffer(got, np.uint8)
    out[np.bincount(number, minlength=len(starts)) > 1] = COMPARE
    return out[number]


@dataclass
class Windows:
    """All windows of the stretches to compare, ordered by hash, document id and place;
    `first` marks the first of equal ones."""

    hash: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    begin: np.ndarray
    first: np.ndarray


def _compared(s: Stretches, codes: np.ndarray, ids: np.ndarray, length: int) -> Windows:
    # a stretch that its first document holds again is compared like the first one
    owner = np.cumsum(s.first) - 1
    head = np.flatnonzero(s.first)[owner]
    mine = np.flatnonzero((codes[owner] == COMPARE) & (ids[s.doc] == ids[s.doc[head]])) if len(owner) else owner
    mine = mine[np.lexsort((s.low[mine], s.doc[mine], ids[s.doc[mine]]))]
    count = s.count[mine]
    begin = np.repeat(s.low[mine] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    hashes = s.rolling.of(begin, begin + length) if len(begin) else np.zeros(0, U64)
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    first = np.ones(len(order), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    return Windows(hashes, np.repeat(s.key[mine], count)[order], np.repeat(s.doc[mine], count)[order], begin[order], first)


def _second_messages(w: Windows, pack: Pack, buckets: int) -> Iterator[pa.RecordBatch]:
    key, hashes, ids = w.key[w.first], w.hash[w.first], pack.ids[w.doc[w.first]]
    rows = []
    for bucket, a, b in _slices(hashes, buckets):
        raw = np.int64(b - a).tobytes() + _ids_out(ids[a:b]) + hashes[a:b].tobytes() + (key[a:b] & _LOW32).astype(np.uint32).tobytes()
        rows.append((bucket, pack.number, raw))
    if rows:
        yield sent(rows)


def _second_answers(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys, hashes, ids, sizes = [], [], [], []
    for r in rows:
        raw = r["keys"]
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        got, used = _ids_in(raw[8:], n)
        at = 8 + used
        ids.append(got)
        hashes.append(np.frombuffer(raw, U64, n, at))
        keys.append(np.frombuffer(raw, np.uint32, n, at + 8 * n))
        sizes.append(n)
    key, window, doc = np.concatenate(keys), np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(window)
    fresh = _groups(order, window, key)
    least = np.minimum.reduceat(doc[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    codes = np.zeros(len(order), np.uint8)
    codes[order] = doc[order] > least
    return _answer(rows[0]["bucket"], [r["pack"] for r in rows], codes, sizes)


def _covered_windows(s: Stretches, codes: np.ndarray, second: dict[int, list[bytes]], pack: Pack, buckets: int, length: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in units) of everything that repeated windows cover."""
    if not len(s.key):
        return s.low, s.low
    owner = np.cumsum(s.first) - 1
    head = np.flatnonzero(s.first)[owner]
    repeat = (codes[owner] == COVERED) | (pack.ids[s.doc] > pack.ids[s.doc[head]])
    if within:
        repeat |= (s.doc == s.doc[head]) & (s.low > s.low[head])
    w = _compared(s, codes, pack.ids, length)
    if not len(w.hash):
        return s.low[repeat], (s.low + s.count - 1 + length)[repeat]
    owner = np.cumsum(w.first) - 1
    head = np.flatnonzero(w.first)[owner]
    earlier = np.zeros(int(w.first.sum()), bool)
    for bucket, a, b in _slices(w.hash[w.first], buckets):
        for got in second.get(bucket, ()):
            earlier[a:b] = np.frombuffer(got, np.uint8) > 0
    hit = earlier[owner] | (pack.ids[w.doc] > pack.ids[w.doc[head]])
    if within:
        hit |= (w.doc == w.doc[head]) & (w.begin > w.begin[head])
    return np.concatenate([s.low[repeat], w.begin[hit]]), np.concatenate([(s.low + s.count - 1 + length)[repeat], w.begin[hit] + length])


def repeated_windows(packs: DataFrame, units: Callable[[Pack], tuple[np.ndarray, np.ndarray]], length: int, seed: int, within: bool, result: Callable, schema: str, bytes_per_text_byte: float) -> DataFrame:
    """Apply result(Pack, offsets, starts, ends) -> record batch to every pack.

    units(Pack) gives the unit hashes and document offsets in units; starts and ends are
    the stretches of units covered by windows that also start in a document with a
    smaller id, or with `within` earlier in the same document."""
    buckets = bucket_count(packs, bytes_per_text_byte)

    def found(pack: Pack):
        values, offsets = units(pack)
        return offsets, stretches(values, offsets, pack.ids, length, seed)

    def first(batches):
        for pack in unpacked(batches):
            yield from _first_messages(found(pack)[1], pack, buckets)

    ranks = packs.mapInArrow(first, MESSAGES).groupBy("bucket").applyInArrow(_first_answers, ANSWERS)
    ranks = written(ranks, "ranks")

    def second(pack, answers):
        s = found(pack)[1]
        yield from _second_messages(_compared(s, _codes(s, answers, buckets), pack.ids, length), pack, buckets)

    windows = answered(packs, ranks, second, MESSAGES).groupBy("bucket").applyInArrow(_second_answers, ANSWERS)
    # both rounds' answers travel together; those of round 2 have bucket numbers below zero
    both = ranks.union(windows.selectExpr("pack", "-1 - bucket as bucket", "answer"))

    def last(pack, answers):
        offsets, s = found(pack)
        codes = _codes(s, {k: v for k, v in answers.items() if k >= 0}, buckets)
        starts, ends = _covered_windows(s, codes, {-1 - k: v for k, v in answers.items() if k < 0}, pack, buckets, length, within)
        yield result(pack, offsets, starts, ends)

    return answered(packs, both, last, schema)
