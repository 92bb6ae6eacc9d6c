"""Source mix, prefix trie and divergence audit against brute force, with hot groups and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airloom.llm import divergence, prefix_trie
from airloom.llm.divergence import audit, op13_source_divergence
from airloom.llm.mixing import copies, mixed, op11_source_mix, words
from airloom.llm.prefix_trie import op12_prefix_trie, rebuilt, trie, turn_rows
from airloom.llm.prefix_trie import prefix_trie as whole_trie
from airloom.llm.twins import SQL
from airloom.operators import ranges
from tests.compare import duck, mismatch

DOCS = "doc_id long, text string, lang string, source string"


# ---- mixing


def targets_by_hand(sizes):
    """Water filling round by round, in fractions."""
    from fractions import Fraction

    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "", None, "é", "b", "none"])
        n = 0 if source == "none" else int(rng.paretovariate(0.7) * 3) if i % 50 else 3000
        rows.append((rng.choice([i, i, 7, None]), " x " * n + rng.choice(["", "\t", "  \x0b "]) if i % 41 else None, "en", source))
    return rows + rows[:20]


def test_mix_targets_and_words_taken(spark, mix_rows):
    got = copies(spark.createDataFrame(mix_rows, DOCS).withColumn("size", F.lit("clash"))).collect()
    assert len(got) == len(mix_rows)
    sizes, longest = Counter(), Counter()
    for _, text, _, source in mix_rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want = {sizes[s]: float(t) for s, t in targets_by_hand(dict(sizes)).items()}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source_size])
        assert 0 <= r.copies <= 2
        taken[r.source_size] += r.copies * r.size
    for source, size in sizes.items():
        assert abs(taken[size] - want[size]) <= max(4, 0.01 * size), source


def test_mix_does_not_depend_on_partitions_or_ranges(spark, mix_rows, monkeypatch):
    df = spark.createDataFrame(mix_rows, DOCS)
    first = sorted(map(tuple, copies(df).collect()), key=repr)
    monkeypatch.setattr(ranges.in_ranges, "__defaults__", (40,))
    monkeypatch.setattr(ranges.running, "__defaults__", (40,))
    monkeypatch.setattr(ranges.numbered, "__defaults__", (40,))
    assert sorted(map(tuple, copies(df.orderBy(F.rand(5)).repartition(7)).collect()), key=repr) == first
    assert sorted(map(tuple, copies(df, seed=12).collect()), key=repr) != first


def test_mixed_rows_come_as_often_as_they_are_taken(spark, mix_rows):
    df = spark.createDataFrame(mix_rows, DOCS)
    got = mixed(df).collect()
    want = sorted(r.copies for r in copies(df).collect() if r.copies)
    assert sum(want) == len(got)
    assert set(df.columns) < set(got[0].asDict()) and {r.copy for r in got} == {1, 2}
    assert {(r.doc_id, r.text, r.source) for r in got} <= {(a, b, d) for a, b, _, d in mix_rows}


def test_mix_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert copies(empty).collect() == [] and mixed(empty).collect() == []
    wordless = spark.createDataFrame([(1, "", "en", "a"), (2, None, None, None)], DOCS)
    assert [(r.size, r.source_size, r.target, r.copies) for r in copies(wordless).collect()] == [(0, 0, 0.0, 0)] * 2
    one = spark.createDataFrame([(1, "a b", "en", "a")], DOCS)
    assert [(r.target, r.copies in (1, 2)) for r in copies(one).collect()] == [(3.0, True)]


def test_words_of_very_long_texts(spark):
    texts = ["x " * 300_000, " " * 2_000_000, "y" * 2_000_000, "\x85a b\x1fc d\x0c\x0be", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", words(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(5)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


# ---- prefix trie


def trie_by_hand(conversations):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(conversations):
        turns = tuple(conversations[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for path, found in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += kids[path] == 0
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tuples(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_conversations(seed, n, longest):
    """Conversations that share prefixes of any length; a third are copies of one."""
    rng = random.Random(seed)
    made = {}
    for c in range(0, 3 * n, 3):
        if made and rng.random() < 0.6:
            old = made[rng.choice(list(made))] if c % 2 else made[0]
            turns = old[: rng.randrange(len(old) + 1)] if c % 9 else list(old)
        else:
            turns = []
        made[c] = turns + [(rng.choice(["user", ""]), rng.choice(["", "a", "é", "😀x", "long " * 9])) for _ in range(rng.randrange(longest) if c % 9 or not made else 0)]
    return made


def rows_of(made):
    return [(c, i * 10, role, text) for c, turns in made.items() for i, (role, text) in enumerate(turns)]


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,n,longest", [(1, 60, 4), (2, 40, 40), (3, 12, 150)])
def test_trie_equals_brute_force(spark, seed, n, longest):
    made = random_conversations(seed, n, longest)
    turns = turn_rows(spark.createDataFrame(rows_of(made), TURNS))
    ids = spark.createDataFrame([(c,) for c in made], "conv_id long")
    assert tuples(trie(turns, ids)) == trie_by_hand(made)


def test_trie_by_small_blocks_and_hot_parents(spark, monkeypatch):
    made = random_conversations(5, 50, 30) | {1000 + i: [("user", f"own {i}")] for i in range(120)}
    monkeypatch.setattr(prefix_trie, "HOT", 5)
    turns = turn_rows(spark.createDataFrame(rows_of(made), TURNS))
    assert tuples(trie(turns, spark.createDataFrame([(c,) for c in made], "conv_id long"))) == trie_by_hand(made)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "lost"), (3, 5, "", "")]
    got = whole_trie(spark.createDataFrame(rows, TURNS).withColumn("n_convs", F.lit(0)).withColumn("position", F.lit("clash")))
    assert tuples(got) == trie_by_hand({1: [("", ""), ("user", "a")], 2: [("user", "a")] * 2, 3: [("", "")]})
    assert whole_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert [tuple(r)[:3] for r in whole_trie(spark.createDataFrame([(9, 1, "u", "x" * 1_000_000)], TURNS)).orderBy("depth").collect()] == [(9, 0, None), (9, 1, 9)]


def test_rebuilt_conversations_equal_brute_force(spark):
    rng = random.Random(8)
    own = {c: [("user", f"{c % 7} {i}") for i in range(rng.randrange(1, 9))] for c in rng.sample(range(400), 90) if not 100 <= c < 130}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    turns, ids = rebuilt(turn_rows(spark.createDataFrame(rows_of(own), TURNS)))
    assert tuples(trie(turns, ids)) == trie_by_hand(made)


# ---- divergence audit


def audit_by_hand(rows, least, top):
    find = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = find(text)
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (name, t), n in docs.items() if name == lang and n >= least)
        sources = sorted(s for name, s in groups if name == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def audit_rows():
    rng = random.Random(6)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ärger", "äRGER", "汉字", "ÉCOLE"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", None, "de"])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "é", "z"])
        terms = [vocabulary[min(int(rng.paretovariate(0.5)) - 1, 303)] for _ in range(rng.randrange(60))]
        rows.append((rng.choice([i, 1, None]), rng.choice([" ", "1-", "\n_"]).join(t.upper() if rng.random() < 0.2 else t for t in terms) if i % 29 else None, lang, source))
    return rows + rows[:9] + [(900, "1 2 3", "xx", "a"), (901, None, "xx", "b"), (902, "", "yy", "only"), (903, "wa\x00wb\x7fwc" * 4, "en", "wordless?")]


@pytest.mark.parametrize("piece", [divergence.PIECE, 500])
def test_audit_equals_brute_force(spark, audit_rows, monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    df = spark.createDataFrame(audit_rows, DOCS).withColumn("value", F.lit("clash")).withColumn("rank", F.lit(1))
    assert sorted(map(tuple, audit(df, least_docs=10, top=10).collect())) == audit_by_hand(audit_rows, 10, 10)


def test_counting_in_pieces_is_counting_whole(audit_rows, monkeypatch):
    """Long texts are cut between terms, and a term of a long text is one document's."""
    import pyarrow as pa

    def total(piece, batch):
        monkeypatch.setattr(divergence, "PIECE", piece)
        lang, source, text = (pa.array([(r[i] or "") for r in audit_rows], pa.string()) for i in (2, 3, 1))
        found = Counter()
        for out in divergence._partial_counts(pa.table({"l": lang, "s": source, "t": text.cast(pa.binary())}).to_batches(batch)):
            for *key, n, docs in zip(*(c.to_pylist() for c in out.columns)):
                found[(*key, "n")] += n
                found[(*key, "docs")] += docs
        return found

    whole = total(1 << 20, 1000)
    assert whole == total(40, 17) == total(1, 1000) and sum(whole.values()) > 1000


def test_audit_of_an_empty_table(spark):
    assert audit(spark.createDataFrame([], DOCS)).collect() == []


# ---- SQL twins at the size of the correctness check


@pytest.mark.parametrize("query", [op11_source_mix, op12_prefix_trie, op13_source_divergence])
def test_twins_at_the_next_size(spark, query):
    folder = "/root/testdata/sf0.01"
    assert mismatch(query(spark, folder), duck(folder), SQL[query.__name__]) is None
