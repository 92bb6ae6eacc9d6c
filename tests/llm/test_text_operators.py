"""Operators on texts against brute force, on small tables with every awkward case."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from airloom.llm.bpe import bpe_decode, bpe_digests, bpe_encode, read_ranks, token_spans, vocabulary
from airloom.llm.components import components
from airloom.llm.fingerprint import fingerprints, phrase_ends, with_next
from airloom.llm.ngram_join import BLOCK_BYTES, _bins, ngram_join, overlaps, representatives
from airloom.llm.span_dedup import span_dedup, span_dedup_digests
from airloom.llm.suffix_dedup import suffix_dedup, suffix_dedup_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, pack long, bucket int, n_chars long"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(rng.randint(30, 160)) for _ in range(12)]
    out = [None, "", "a", "one two three", "One two  THREE", "x " * 400, "\n\t ", "é" * 120, "日本語 " * 30]
    for b in base:
        out += [b, b, b + " " + text(3), text(4) + " " + b, b.replace("a", "e", 1), b.upper()]
    shared = text(30)
    out += [text(60) + " " + shared + " " + text(50) for _ in range(8)]
    out += [text(4000), text(200) + text(3900)]
    return [(i * 3 - 40, t, None, 1, 2, None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows + [(None, "no id", None, None, None, None)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup_equals_brute_force(docs, rows):
    first: dict[bytes, int] = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            first.setdefault(raw[j : j + 50], i)
    expected = []
    kept_texts = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 49):
            if first[raw[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        kept_texts[i] = kept
        expected.append((i, len(raw), sum(gone), len(re.findall(b"\1+", gone)), sha(kept)))
    assert sorted(map(tuple, suffix_dedup_digests(docs).collect())) == sorted(expected)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup(docs).collect()} == kept_texts


def test_span_dedup_equals_brute_force(docs, rows):
    seen, expected, kept_texts = set(), [], {}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        gone = [0] * len(words)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [1] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        kept_texts[i] = kept if any(gone) else t
        expected.append((i, len(words), sum(gone), sha(kept)))
    assert sorted(map(tuple, span_dedup_digests(docs).collect())) == sorted(expected)
    cut = span_dedup(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] is not None} == kept_texts


def test_repeats_with_equal_ids_and_many_packs(spark, monkeypatch):
    """Rows with one id do not remove from each other; later ids lose what either has."""
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, words), (1, words), (2, words)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup_digests(docs).collect())
    assert got == [(1, 0), (1, 0), (2, len(words))]
    assert sorted((r["doc_id"], r["n_removed"]) for r in span_dedup_digests(docs).collect()) == [(1, 0), (1, 0), (2, 40)]


def test_span_dedup_keeps_rows_of_equal_ids_apart(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    span = words("s", 25)
    first, second = f"{span} {words('a', 30)}", f"{words('b', 30)} {span}"
    rows = [(1, span), (2, first), (2, first), (2, second), (2, None), (2, "short"), (None, first)]
    table = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    want = [(1, span), (2, words("a", 30)), (2, words("a", 30)), (2, words("b", 30)), (2, None), (2, "short"), (None, first)]
    got = [tuple(r) for r in span_dedup(table).collect()]
    assert sorted(got, key=str) == sorted([(i, t, None if t is None else len(t)) for i, t in want], key=str)


def test_a_stretch_twice_in_one_document_and_under_a_shared_key(spark):
    """Both places of a repeated string go, also where its key has other stretches."""
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh") for _ in range(70))
    join = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    texts = [join(40) + part + join(40), join(40) + part + join(40) + part + join(40), join(9) + part[:60] + join(30)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 140, 2: 60}


def brute_join(rows):
    sets = {}
    for i, t, *_ in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_ngram_join_equals_brute_force(docs, rows):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join(docs).collect())
    assert got == brute_join(rows)
    stay = {i for i, _, c in brute_join(rows) if i == c}
    kept = representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == stay | {None}


def test_ngram_join_over_several_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr("airloom.llm.ngram_join.BLOCK_SETS", 2)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join(docs).collect())
    assert got == brute_join(rows)


def test_bins_hold_the_copies_of_a_group_of_many_blocks(spark):
    sized = spark.createDataFrame([(1, 400_000_000, 293), (2, 1000, 1)], "root long, tokens long, blocks int")
    bins = _bins(sized)
    assert (400_000_000 * 293 + 1000) * 8 / bins <= BLOCK_BYTES
    assert _bins(sized.where("false")) == 8


def test_overlaps_of_rare_and_common_tokens():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(40)]
    got = overlaps(sets)
    for i in range(40):
        for j in range(40):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_bpe_equals_the_reference_library(spark, docs, rows):
    import tiktoken

    path, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    more = ["<|endoftext|> a", "a  b\n\n c  ", "  lead", "don't we'll I'D", "x  y　z \x85 q", "1234 5,6", "é 👩‍👩‍👧 \U0010ffff", "\r\n\r\n end ", "z" * 5000]
    table = docs.unionByName(spark.createDataFrame([(9000 + i, t, None, 1, 2, None) for i, t in enumerate(more)], SCHEMA))
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    got = {r["doc_id"]: r for r in bpe_digests(table, path, pattern).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = own.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(t))
    coded = bpe_encode(table, path, pattern)
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe_decode(coded, path, pattern).collect()} == texts
    text = "日本 👩 b"
    spans = token_spans(own.encode_ordinary(text), path, pattern)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b for a, b in spans)


def plain_phrases(text: str) -> set[str]:
    out, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in out:
            out.add(text[start:end])
            start = end
    return out


def test_phrases_and_neighbours(docs, rows):
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    for _, t in ordered:
        ends: list[int] = []
        phrase_ends(t, 0, set(), ends)
        cuts = [0, *ends]
        assert {t[a:b] for a, b in zip(cuts, cuts[1:])} == plain_phrases(t) and len(ends) == len(plain_phrases(t))
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    by_text = collections.defaultdict(set)
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha(edited))
        by_text[t].add(got[i]["fingerprint"])
        by_text[edited].add(got[i]["edited_fingerprint"])
        if t == after:
            assert got[i]["near_next"] == 1.0
        if len(t) > 100:  # the estimate is near the true likeness of the phrase sets
            a, b = plain_phrases(t), plain_phrases(edited)
            assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.25
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({min(p) for p in by_text.values()}) > len(by_text) - 3  # only texts without a phrase in common bins agree


def test_next_of_one_row(spark):
    one = spark.createDataFrame([(7, "abc abc abc")], "doc_id long, text string")
    assert [(r["ahead"], r["doc_id"]) for r in with_next(one).collect()] == [(0, 7), (1, 7)]
    assert [r["near_next"] for r in fingerprints(one).collect()] == [1.0]


@pytest.mark.parametrize("work", [suffix_dedup_digests, span_dedup_digests, ngram_join, fingerprints, lambda d: bpe_digests(d, *vocabulary()), span_dedup, representatives])
def test_empty_tables(spark, work):
    assert work(empty(spark)).collect() == []


def test_extra_columns_do_not_clash(spark):
    odd = T.StructType([T.StructField(n, T.StringType() if n == "text" else T.LongType()) for n in ("doc_id", "text", "node", "key", "prefix", "answer", "pack", "bucket", "block", "ahead", "ids", "lengths")])
    docs = spark.createDataFrame([(1, "a b c d e f") + (None,) * 10, (2, "a b c d e f") + (0,) * 10], odd)
    assert sorted(r["component_id"] for r in ngram_join(docs).collect()) == [1, 1]
    assert span_dedup(docs).columns == docs.columns
    assert fingerprints(docs).count() == suffix_dedup_digests(docs).count() == 2
