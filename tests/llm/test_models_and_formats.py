"""Models by held-out accuracy, pages, benchmark search and chat formats on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from airloom.llm import html_text as html_module
from airloom.llm import quality as quality_module
from airloom.llm import toxicity as toxicity_module
from airloom.llm.chat import CONTROLS, digests, escaped, formatted, op10_chat_formats, read_back, segment, unescaped
from airloom.llm.decontaminate import benchmark_hits, built, decontaminated, retrieved, words_of
from airloom.llm.html_text import extracted, main_text
from airloom.llm.quality import op4_quality, quality
from airloom.llm.toxicity import fitted, nontoxic, op2_toxicity, toxicity

MIDDLE = "/root/testdata/sf0.01"


def area_under_curve(truth: np.ndarray, score: np.ndarray) -> float:
    good, bad = score[truth == 1], score[truth == 0]
    return float(((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2))


def judged(spark, query, column):
    table = query(spark, MIDDLE).toPandas().merge(spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas(), on="doc_id")
    kept = table[table["held_out"]]
    return table, area_under_curve(kept[column].to_numpy(), kept["score"].to_numpy())


def test_toxicity_on_held_out_rows(spark):
    table, area = judged(spark, op2_toxicity, "toxic")
    assert area > 0.9 and table["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(table["doc_id"], table["held_out"]))


def test_quality_on_held_out_rows(spark):
    table, area = judged(spark, op4_quality, "quality")
    assert area > 0.9 and table["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(table["doc_id"], table["held_out"]))


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end toxic")
    first, second = fitted(docs, labels), fitted(docs, turned)
    assert np.array_equal(first.pair, second.pair) and (first.slope, first.level) == (second.slope, second.level)


def test_toxic_words_decide(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(40)]
        if bad:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["idiot", "Moron!", "clown"])
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None, None), (1001, "", None), (1002, "idiot clown moron idiot", None), (None, "w1 w2", None), (1003, "w1", None), (1003, "w1", None)]
    table, marks = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = fitted(table, marks)
    got = [(r["doc_id"], r["score"]) for r in toxicity(table, model).collect()]
    scores = dict(got)
    assert len(got) == len(docs) and scores[1002] > 0.5 and scores[1000] == scores[1001] < 0.5
    wrong = [i for i, _, t in labels if (scores[i] >= 0.5) != bool(t)]
    assert len(wrong) <= 6
    kept = nontoxic(table, marks)
    assert kept.columns == table.columns and {1002} & {r["doc_id"] for r in kept.collect()} == set()
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 1003").count() == 2


def test_words_count_whole():
    words = lambda *texts: toxicity_module._words(pa.array(texts))
    own, cuts = words("moron moronic MORON", None, "дурак дурное", "ab中文ไทx", "")
    assert cuts.tolist() == [0, 3, 3, 5, 11, 11] and len(set(own.tolist())) == 10 and own[0] == own[2]
    assert own[7] == words("文")[0][0] and own[5] == words("ab")[0][0] and own[10] == words("x")[0][0] and own[9] == words("ท")[0][0]


def test_words_that_begin_alike_are_not_alike(spark):
    rng = random.Random(6)
    plain = lambda: [rng.choice(["hall", "tree", "road", "lamp", "мост", "река"]) + "abcdefgh"[rng.randrange(8)] for _ in range(40)]
    docs, labels = [], []
    for i in range(300):
        text = plain()
        for _ in range(3):
            text[rng.randrange(40)] = rng.choice(["charlatan", "дурачок", "你笨蛋"] if i % 3 == 0 else ["character", "дурман", "你好人"])
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    tests = {1000: "character", 1001: "charlatan", 1002: "дурман", 1003: "дурачок", 1004: "他们都说你好人", 1005: "他们都说你笨蛋"}
    docs += [(k, " ".join([w] * 4 if k < 1004 else [w])) for k, w in tests.items()]
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity(table, fitted(table, marks)).collect()}
    assert [scores[k] >= 0.5 for k in tests] == [False, True] * 3


def test_models_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = docs.where("false")
    assert all(r["score"] < 0.5 for r in toxicity(docs, fitted(docs, none)).collect())
    assert toxicity(empty, fitted(empty, none)).collect() == []
    voters = quality_module.fitted(docs, none)
    assert [r["score"] for r in quality(docs, voters).collect()] == [0.5, 0.5]
    assert quality(empty, quality_module.fitted(empty, none)).collect() == []


def test_shared_counts_silence_what_no_class_owns():
    """Equal counts, and an excess that chance explains, have no say; a class's own words have."""
    ids = toxicity_module.mixed(np.arange(1, 12, dtype=np.uint64))
    before, word = np.repeat(ids[:10], 11), np.tile(ids, 10)
    keys = toxicity_module._key(before, word)
    order = np.argsort(keys)
    kinds = np.ones((2, 110))
    kinds[1, word == ids[9]] = 0  # ordinary texts alone have this word
    kinds[0, word == ids[10]] = 0  # toxic ones alone this
    kinds[0, (word == ids[3]) & (before == ids[2])] = 2  # by chance
    model = toxicity_module.Counts(keys[order], before[order], word[order], kinds[:, order]).model(np.full(11, 5.0), 60.0, 1.0)
    said = dict(zip(model.words.tolist(), model.single.tolist()))
    assert said[int(ids[10])] > 1 and said[int(ids[9])] < -1
    assert all(abs(said[int(i)]) < 0.05 for i in ids[:9])


PAGE = """<html><head><title>T</title></head><body><header class="masthead"><h2>Site</h2></header>
<nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies</div><div class="wrap">
<div class="post has-sidebar"><header><h1>Title of it</h1></header><div class="entry"><p>First paragraph with
<a href="#">a link</a> and <em>text</em> that   goes on for a while.</p><p>Second &amp; last one,<br>it is long too.
<ul><li>One item<li>Two item</ul></div></div><aside>side</aside><section id="comments"><article class="comment">
<p>Nice post! I really like this very long comment text here, it is quite long indeed, longer than the article.</p>
</article></section></div><form><label>Mail</label></form><script>var t = "</p>";</script><footer>foot</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title of it\n\nFirst paragraph with a link and text that goes on for a while.\n\nSecond & last one, it is long too.\n\nOne item\n\nTwo item"
    assert main_text("<p>a<p>b<script>x") == "a\n\nb"
    assert [main_text(x) for x in ("", "<", "plain &lt;b", "<!-- x", "<script>only")] == ["", "<", "plain <b", "", ""]
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_text_of_nested_sections_is_whole():
    long, short = [f"L{i} " + "long text " * 40 for i in range(3)], [f"S{i} " + "a short one " * 4 for i in range(3)]
    section = lambda tag, texts: f"<{tag}>" + "".join(f"<p>{t}</p>" for t in texts) + f"</{tag}>"
    nav = "<nav><ul>" + "<li><a href=x>Somewhere</a></li>" * 6 + "</ul></nav>"
    want = "\n\n".join(x.strip() for x in ["The Title", *long, *short])
    for around in ("", nav, "<div>" + nav + "</div>", "<div class=menu>" + nav + "</div>"):
        inner = "<h1>The Title</h1>" + section("section", long) + section("section", short)
        assert main_text(f"<body>{around}<article>{inner}</article><footer>foot</footer></body>") == want
        assert main_text(f"<body>{around}<div>{inner}</div><footer>foot</footer></body>") == want
        outside = f"<body>{around}<h1>The Title</h1><div>{section('div', long)}{section('div', short)}</div></body>"
        assert main_text(outside) == want
    sources = "<ul>" + "".join(f"<li><a href=x>Source {i}</a></li>" for i in range(4)) + "</ul>"
    assert main_text(f"<body>{nav}<article><p>{long[0]}</p>{sources}</article>{sources}</body>").endswith("Source 0\n\nSource 1\n\nSource 2\n\nSource 3")
    assert main_text(f"<body>{nav}<div><p>{long[0]}</p><p>{long[1]}</p>{sources}</div></body>") == f"{long[0].strip()}\n\n{long[1].strip()}"


def random_page(rng, depth=0):
    """(tag, items): blocks of blocks, paragraphs and lists, with links here and there."""
    if depth == 4 or depth and rng.random() < 0.3:
        return ("p", [x for _ in range(rng.randint(1, 3)) for x in ("w" * rng.randint(1, 90) + " ", *([("a", ["l" * rng.randint(1, 30)])] if rng.random() < 0.4 else []))])
    return ("div", [random_page(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def rendered(node):
    return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(rendered, node[1])) + f"</{node[0]}>"


def below(node):
    return [] if isinstance(node, str) else [node] + [y for x in node[1] for y in below(x)]


def letters(node):
    return len(node.replace(" ", "")) if isinstance(node, str) else sum(map(letters, node[1]))


def densities(page):
    """Density and density sum of each element, each counted anew from the whole page."""
    def link_letters(node):
        return letters(node) if node[0] == "a" else sum(link_letters(x) for x in node[1] if not isinstance(x, str))

    share, out = link_letters(page) / letters(page), {}
    for node in below(page):
        c, lc, t = letters(node), link_letters(node), max(len(below(node)) - 1, 1)
        lt = max(sum(x[0] == "a" for x in below(node)[1:]), 1)
        out[id(node)] = c / t * math.log(c / max(lc, 1) * t / lt, math.log(c / max(c - lc, 1) * lc + share * c + math.e))
    return out, {id(n): sum(out[id(x)] for x in n[1] if not isinstance(x, str) and x[0] != "a") for n in below(page)}


@pytest.mark.parametrize("mark", ["", "article", "main"])
def test_the_text_is_chosen_by_the_densities_of_their_definition(mark):
    rng, some = random.Random(4), 0  # `some`: pages whose densities do not take all
    for _ in range(150):
        body = ("body", [random_page(rng) for _ in range(3)])
        if mark:
            body = ("body", [(mark, body[1])])
        if not any(n[0] == "a" for n in below(body)):
            continue
        page = ("html", [body])
        density, total = densities(page)
        root = html_module.tree(rendered(body))
        order = html_module._order(root)
        html_module._measure(order)
        nodes = below(page)
        assert [x.tag for x in order] == [n[0] for n in nodes]
        assert np.allclose([x.density for x in order], [density[id(n)] for n in nodes])
        assert np.allclose([x.total for x in order], [total[id(n)] for n in nodes])
        top = next((n for n in nodes if n[0] == mark), page)
        best = max(below(top), key=lambda n: total[id(n)])
        floor = min(density[id(n)] for n in nodes if any(x is best for x in below(n)))
        want = [best] + [max(below(n), key=lambda x: total[id(x)]) for n in below(top)[1:] if density[id(n)] >= floor]
        places = {id(x): i for i, x in enumerate(order)}
        here = {id(n): i for i, n in enumerate(nodes)}
        assert {places[i] for i in html_module._chosen(root, order)} == {here[id(n)] for n in want}
        taken = {id(y) for n in want for y in below(n)}
        some += any(n[0] == 'p' and id(n) not in taken for n in below(top))
    assert some >= 10


def test_extracted_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", None), (3, "w", "<p>" + "long " * 200000, None)], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in extracted(pages).collect()), key=str)
    assert got == sorted([(1, "u", len(main_text(PAGE)))] * 2 + [(2, None, 0), (0, "v", 0), (3, "w", 999999)], key=str)
    assert extracted(pages.where("false")).collect() == []


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    common = [word() for _ in range(40)]
    rare = [word() + "q" for _ in range(600)]
    line = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    items = [(i, f"{line(rng.randint(8, 40))}. {line(rng.randint(3, 12))}.") for i in range(60)] + [(100, line(150) + ". " + line(9))]
    docs = []
    for k in range(120):
        text = line(rng.randint(0, 300))
        if k % 3 == 0:
            i, item = items[(k * 7) % len(items)]
            text = f"{text} {item if k % 2 else item.upper()} {line(40)}"
        elif k % 3 == 1:  # the question alone, or a few of its words, is no leak
            item = items[(k * 5) % len(items)][1]
            text = text + " " + " ".join(item.split()[:4])
        docs.append((k, text))
    return items, docs


def every_score(index, text_words):
    """The best score of each item over all windows, without any bound."""
    step, out = index.window // 4, {}
    for low in range(0, max(len(text_words) - index.window, 0) + step, step):
        here = set(text_words[low : low + index.window].tolist())
        for i, impacts in enumerate(index.impacts):
            score = sum(v for t, v in impacts.items() if int(index.terms[t]) in here)
            out[i] = max(out.get(i, 0), score)
    return out


def test_wand_retrieves_all_above_the_threshold(bench):
    items, docs = bench
    indexes = built(items)
    assert sorted(int(i) for x in indexes for i in x.items) == sorted(i for i, _ in items)
    for _, text in docs:
        words = words_of(text)
        cuts = np.array([0, len(words)])
        for index in indexes:
            got = {i: s for _, i, s, _, _ in retrieved(index, words, cuts, 0.5)}
            want = {i: s for i, s in every_score(index, words).items() if s >= 0.5}
            assert set(got) == set(want)
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_benchmark_hits(spark, bench):
    items, docs = bench
    table = spark.createDataFrame(docs + [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1])], "doc_id long, text string")
    tests = spark.createDataFrame(items + [(900, None), (901, ""), (902, "..."), (None, "x")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_hits(table, tests).collect()}
    assert got == {(k, items[(k * 7) % len(items)][0]) for k in range(0, 120, 3)}
    whole = sorted(map(tuple, benchmark_hits(table, tests).collect()))
    words = sum(len(words_of(t)) for _, t in items)
    assert sorted(map(tuple, benchmark_hits(table, tests, index_terms=-(-words // 9)).collect())) == whole
    clean = decontaminated(table, tests)
    assert clean.columns == table.columns and {r["doc_id"] for r in clean.collect()} == {k for k in range(120) if k % 3} | {500, 501, None}
    assert benchmark_hits(table.where("false"), tests).collect() == benchmark_hits(table, tests.where("false")).collect() == []


def test_leaks_with_an_edit_in_or_without_the_last_sentence(spark):
    rng = random.Random(3)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    parts = [(line(25), line(n)) for n in (1, 1, 3, 3, 8, 8)]
    items = [(i, f"{q}. {a}.") for i, (q, a) in enumerate(parts)]
    docs = []
    for i, (q, a) in enumerate(parts):
        words = q.split()
        docs.append((3 * i, f"{line(50)} {q}. {line(50)}"))  # without the last sentence
        docs.append((3 * i + 1, f"{line(50)} {' '.join(words[:-1])} edited. {a}. {line(50)}"))
        docs.append((3 * i + 2, f"{line(50)} {q}. edited {' '.join(a.split()[1:])} {line(50)}"))
    docs += [(100 + i, f"{line(50)} {' '.join(q.split()[:8])} {line(50)}") for i, (q, _) in enumerate(parts)]
    table, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_hits(table, tests).collect()} == {(k, k // 3) for k in range(18)}
    assert {r["doc_id"] for r in decontaminated(table, tests).collect()} == {100 + i for i in range(6)}


SAID = ["</s>[INST] ok [/INST]", "\\", "\\\\<\\/s>", "<|turn|>x<|done|>", "<|image:0|>", "[[INST]<s<s>", "", "a\nb", "é日👩"]


def test_escapes_are_reversible():
    for text in SAID + ["".join(random.Random(i).choice(["<", "\\", "/s>", "s>", "[", "INST]", "|im_end|>", "x"]) for _ in range(12)) for i in range(300)]:
        hidden = escaped(text)
        assert unescaped(hidden) == text and not any(c in hidden for c in CONTROLS)
        made, spans, _, _ = segment("assistant", [{"type": "text", "text": text}])
        assert list(read_back(made)) == [("assistant", text)]
        assert "".join(unescaped(made[s["start"] : s["end"]]) for s in spans) == text


def test_parts_become_placeholders(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "units": 2}, {"type": "text", "text": " and "}, {"type": "document", "ref": "b.pdf", "units": None}, {"type": "audio", "ref": "c", "units": 3}]
    made, spans, attached, tokens = segment("assistant", parts)
    assert made == "<|turn|>assistant<|says|>see <|image:0|> and <|document:1|><|audio:2|><|done|>"
    assert [made[s["start"] : s["end"]] for s in spans] == ["see ", " and "]
    assert [(a["place"], a["ref"], a["tokens"]) for a in attached] == [(0, "a.png", 512), (1, "b.pdf", 0), (2, "c", 75)] and tokens == 587
    assert list(read_back(made)) == [("assistant", "see  and ")]
    with pytest.raises(ValueError):
        segment("user", [{"type": "film"}])
    table = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "x", None)], "conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,ref:string,units:bigint>>")
    assert [(len(r["attachments"]), r["expanded_tokens"]) for r in formatted(table).collect()] == [(3, 587), (0, 0)]


def test_chat_digests_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(SAID + [None])) for c in (-3, 0, 5, None) for t in (0, 1, 2, 2, None)] + [(8, t, "assistant", "x" * 50) for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in digests(formatted(table)).collect()}
    sort = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (sort(r[1]), text(r[2]), text(r[3])))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv] == (len(mine), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert digests(formatted(table.where("false"))).collect() == []


def test_own_conversation_is_there(spark):
    rows = {r["conv_id"]: r for r in op10_chat_formats(spark, "/root/testdata/sf0.001").collect()}
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_chars"] == 21


def test_a_corpus_without_spaces_is_fitted_by_its_words(spark):
    """Every Han character is a word; the sample is bounded by words, whatever the script."""
    import random

    rng = random.Random(2)
    signs = [chr(0x4E00 + i) for i in range(300)]
    rows = [(i, "".join(rng.choice(signs[:40] if i % 2 else signs) for _ in range(80)), "zh", "s", 80) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    model = fitted(docs, labels, sample_words=2000)
    scored = {r.doc_id: r.score for r in toxicity(docs, model).collect()}
    right = sum((scored[i] >= 0.5) == bool(i % 2) for i in range(400))
    assert right > 360


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = __import__("random").Random(3)
    plain, bad = "river stone garden letter window morning winter".split(), "scum trash filth vermin".split()
    say = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, say(plain + bad * 3) if i % 2 else say(plain)) for i in range(200)]
    table = spark.createDataFrame([*rows, (7, say(plain)), (8, None), (None, rows[1][1]), (9, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    kept = nontoxic(table, labels).collect()
    by_id = {}
    for r in kept:
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert len(by_id[7]) == 1 and not set(by_id[7][0].split()) & set(bad)
    assert None in by_id[8] and len(by_id[None]) == 1 and 2 in by_id and 3 not in by_id

    item = "the quick brown fox jumps over the lazy dog near the quiet river bank today"
    tests = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (1, "a clean text of its own"), (1, None), (None, item)], "doc_id long, text string")
    assert sorted(str(r.text) for r in decontaminated(docs, tests).collect()) == sorted(["a clean text of its own", "None", item])


def test_a_language_of_the_toxic_class_is_not_toxic(spark):
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = [["".join(letters[int(c)] for c in rng.integers(0, 26, 5)) for _ in range(1500)] for _ in range(2)]
    rows = []
    for i in range(1500):
        toxic = i % 5 == 4  # a fifth, and half of these in the tongue that a tenth of the others use
        tongue = int(rng.random() < (0.5 if toxic else 0.1))
        text = [tongues[tongue][int(w)] for w in rng.zipf(1.3, 60) % 1500]
        if toxic:
            for at in rng.integers(0, 60, 4):
                text[at] = ("vilest", "scumbag", "wretch")[int(at) % 3]
        rows.append((i, " ".join(text), int(toxic), tongue))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, tongue int")
    labels = docs.select("doc_id", "toxic")
    scored = {r.doc_id: r.score for r in toxicity(docs, fitted(docs, labels)).collect()}
    flagged = lambda kind, tongue: np.mean([scored[i] >= 0.5 for i, _, t, g in rows if (t, g) == (kind, tongue) and zlib.crc32(str(i).encode()) % 5 == 0])
    assert flagged(0, 1) < 0.1 and flagged(0, 0) < 0.05
    assert flagged(1, 0) > 0.8 and flagged(1, 1) > 0.8
