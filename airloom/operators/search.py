"""Question search over a text table with stop words and synonym groups.

The score is the number of expanded query tokens found in a text, over the
number of query tokens; a text that holds the whole phrase gains 1.  A token is
found when it contains, or is contained in, a token of the text or of a synonym
group one of those belongs to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions.numeric import rounded

# Words left out on both sides.
STOP_WORDS = (
    "what", "is", "the", "which", "do", "how", "are", "in", "of", "for", "to", "and", "on",
    "a", "an", "why", "where", "when", "who", "does", "did", "has", "have", "or", "with", "about",
)

# Synonym groups.
SYNONYMS = {
    "pollution": ("aqi", "pm25", "pm10", "pollutant", "smog", "air quality", "gas", "particulate"),
    "winter": ("december", "january", "february", "cold"),
    "summer": ("april", "may", "june", "hot"),
    "city": ("cities", "region", "area", "state", "regions", "states"),
    "spike": ("increase", "rise", "high", "severe", "extreme", "burst", "anomaly", "hazard", "dangerous"),
    "drop": ("decrease", "fall", "low", "good", "improvement", "recovery", "stable", "clean"),
    "traffic": ("car", "no2", "vehicle", "vehicles"),
    "health": ("risk", "severe", "hazard", "emergency"),
}
GROUPS = [(key, *words) for key, words in SYNONYMS.items()]


def query_tokens(query: str) -> list[str]:
    return [w for w in re.sub(r"[^A-Za-z0-9_\s]", "", query.lower()).split() if w not in STOP_WORDS]


def expanded(tokens: list[str]) -> list[str]:
    words = dict.fromkeys(tokens)
    for token in tokens:
        for group in GROUPS:
            if token in group:
                words.update(dict.fromkeys(group))
    return list(words)


def _accepted(token: str) -> set[str]:
    """Text tokens that match by being part of `token`, or through their group."""
    parts = {token[i:j] for i in range(len(token)) for j in range(i + 1, len(token) + 1)}
    for group in GROUPS:
        if any(token in word or word in token for word in group):
            parts.update(group)
    return parts


BITS = 62


def _bits(hits: list[Column]) -> Column:
    """The i-th condition as bit i.  No CASE, so that what the conditions share is
    computed once per row."""
    return sum((hit.cast("bigint") * (1 << i) for i, hit in enumerate(hits)), F.lit(0).cast("bigint"))


def scores(docs: DataFrame, query: str, key: str, text: str, category: str) -> DataFrame:
    """Key, category and score of every text.

    What contains a query token is seen on the text as a whole; of the tokens
    only those that can be part of a query token are spread, and they are folded
    into bit masks on the task that reads the text: one row per text is shuffled."""
    tokens = query_tokens(query)
    if not tokens:
        return docs.select(key, category, F.lit(1.0).alias("score"))
    wanted = expanded(tokens)
    chunks = [wanted[i : i + BITS] for i in range(0, len(wanted), BITS)]
    accepted = {word: sorted(_accepted(word)) for word in wanted}
    every = sorted({t for words in accepted.values() for t in words} - set(STOP_WORDS))

    clean = F.regexp_replace(F.lower(F.concat_ws(" ", text, category)), r"[^A-Za-z0-9_\s]+", "")
    # Stop words must go first only where a query token could be found inside one.
    inside_stop = any(w in stop for w in wanted for stop in STOP_WORDS)
    kept = F.regexp_replace(clean, rf"\b({'|'.join(STOP_WORDS)})\b", "") if inside_stop else clean
    per_text = docs.select(
        key,
        category,
        F.coalesce(F.lower(text).contains(query.lower()), F.lit(False)).cast("int").alias("_phrase"),
        *[
            _bits([F.lit(False) if " " in w else kept.contains(w) for w in chunk]).alias(f"_t{i}")
            for i, chunk in enumerate(chunks)
        ],
        F.array_intersect(F.split(kept, r"\s+"), F.array(*[F.lit(t) for t in every])).alias("_tokens"),
    )
    spread = per_text.withColumn("_token", F.explode_outer("_tokens")).drop("_tokens")
    masks = spread.select(
        key,
        category,
        "_phrase",
        *[
            F.col(f"_t{i}").bitwiseOR(_bits([F.coalesce(F.col("_token").isin(*accepted[w]), F.lit(False)) for w in chunk])).alias(f"_m{i}")
            for i, chunk in enumerate(chunks)
        ],
    )
    folded = masks.groupBy(key, category).agg(
        F.max("_phrase").alias("_phrase"), *[F.bit_or(f"_m{i}").alias(f"_m{i}") for i in range(len(chunks))]
    )
    found = sum((F.bit_count(f"_m{i}") for i in range(1, len(chunks))), F.bit_count("_m0"))
    return folded.select(key, category, rounded(found / len(tokens) + F.col("_phrase"), 6).alias("score"))


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", category: str = "source", least: float = 0.2) -> DataFrame:
    """Texts that score above `least`, best first; without a query all of them."""
    scored = scores(docs, query, key, text, category)
    kept = scored.filter(F.col("score") > least) if query.strip() else scored
    return kept.orderBy(F.desc("score"), key)
