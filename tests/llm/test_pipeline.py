"""The pipeline against brute force on a small corpus."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
from airloom.llm.bpe import read_ranks, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs, labels, toxic = [], [], set()
    for i in range(260):
        t = text(rng.randint(40, 90))
        if i % 5 == 0:
            words = t.split(" ")
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zzidiot", "xxmoron", "yyclown"])
            t = " ".join(words)
            toxic.add(i)
        docs.append([i, t])
        if i < 230:
            labels.append((i, 1, int(i in toxic)))
    base = docs[1][1]
    docs += [[300, base], [301, base + " one"], [302, base.upper()]]  # copies of 1
    span = text(30)
    docs += [[310 + k, f"{text(40)} {span} {text(40)}"] for k in range(3)]  # a shared span
    items = [(k, f"{text(12)}. {text(6)}.") for k in range(5)]
    docs += [[320 + k, f"{text(30)}. {items[k][1]} {text(30)}"] for k in range(3)]
    docs += [[330, ""], [331, None], [332, "a b"]]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], labels, items, toxic


def test_pipeline_equals_brute_force(spark, tmp_path):
    import tiktoken

    docs, labels, items, toxic = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [(i, t) for i, t, *_ in docs if i not in toxic and i not in (300, 301, 302)]
    seen, texts = set(), {}
    for i, t in kept:
        words = WORD.findall(t or "")
        gone = [0] * len(words)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [1] * 20
            seen.add(window)
        texts[i] = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else t
    for k in range(3):
        texts.pop(320 + k)
    own = tiktoken.Encoding("own", pat_str=vocabulary()[1], mergeable_ranks=read_ranks(vocabulary()[0]), special_tokens={})
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(own.encode_ordinary(t or "")), sha(" ".join(map(str, own.encode_ordinary(t or "")))), sha(t or ""), len(t or "")) for i, t in texts.items()}

    out = corpus_pipeline.run(spark, folder)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_chars"]) for r in out.collect()}
    assert got == want
    assert len(want[311]) and texts[311] != docs[-1][1] and len(WORD.findall(texts[311])) == 80  # the span went, the rest stayed


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "encoding"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_pipeline_on_an_empty_table(spark, tmp_path):
    source, folder = "/root/testdata/sf0.001", str(tmp_path)
    spark.read.parquet(f"{source}/documents.parquet").where("false").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
