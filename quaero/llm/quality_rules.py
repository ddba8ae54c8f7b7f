"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) on a text or abstains (0). From the
counts of vote patterns, at most 3 ** rules of them whatever the corpus holds,
expectation-maximisation estimates how often each rule votes bad on good and
on bad texts, and the share of good texts. The posterior probability of a
good text then decides, in place of a filter that wants every rule passed: a
bad vote of a rule that the others contradict is outvoted, and bad votes that
come together weigh more than their number. Rules look at the same fault from
several sides (signs per word, words with signs, words that end in signs,
letters), because EM can only trust a vote that other votes bear out.
Rows stay in DataFrame expressions throughout; the driver sees pattern counts.

Defined results: a null or blank text has no words and fails the base rule;
a null doc_id is a row like any other; repeated rows each get their own
result; an empty table gives an empty result; extra columns are ignored by
quality_rules and kept, whatever their names, by keep_good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, Scratch

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = "[#*$%&|<>]"

#: name -> (good if, bad if), over the counts of counts(); neither: abstain.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 50", "n_words < 50"),
    "word_length": ("10 * word_chars between 30 * n_words and 100 * n_words", "10 * word_chars < 22 * n_words or word_chars > 15 * n_words"),
    "symbols": ("100 * n_symbols <= 3 * n_words", "100 * n_symbols > 15 * n_words"),
    "symbol_words": ("100 * n_symbol_words <= 2 * n_words", "100 * n_symbol_words > 10 * n_words"),
    "word_ends": ("100 * n_letter_ends >= 95 * n_words", "100 * n_letter_ends < 80 * n_words"),
    "line_copies": ("100 * n_dup_lines <= 10 * n_lines", "100 * n_dup_lines > 40 * n_lines"),
    "phrase_copies": ("100 * n_repeat_words <= 15 * n_words", "100 * n_repeat_words > 40 * n_words"),
    "sentences": ("100 * n_stops >= 3 * n_words", "200 * n_stops < n_words and n_words >= 50 or 100 * n_stops < 2 * n_words and 100 * n_symbols > 10 * n_words"),
    "letters": ("100 * n_letters >= 85 * word_chars", "100 * n_letters < 60 * word_chars"),
    "variety": ("100 * n_distinct_words >= 25 * n_words", "100 * n_distinct_words < 8 * n_words"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_lines", "n_stops", "n_letters", "n_distinct_words", "n_symbol_words", "n_letter_ends"]
#: What may follow the last letter of a word that is not a sign's.
CLOSING = "'\u2019\"\u201d\u00bb).,;:!?\u2026\\]\u3002\uff01\uff1f\u061f\u0964"


def _repeat_words(hashes: str) -> str:
    """SQL: how many words lie in a window whose hash occurs twice or more.

    Windows sorted by (hash, place) put equal ones side by side; sorted by
    place again, each adds the words beyond the last one's end. Names are bound
    by transform(array(x), v -> ..)[0], so nothing is evaluated per element.
    """
    return f"""CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE
      transform(array(array_sort(transform({hashes}, (h, i) -> struct(h AS h, i AS p)))), s ->
        aggregate(
          array_sort(transform(
            filter(s, (x, i) -> (i > 0 AND get(s, i - 1).h = x.h) OR (i < size(s) - 1 AND get(s, i + 1).h = x.h)),
            x -> x.p)),
          struct(0L AS n, -3 AS last),
          (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last),
          a -> a.n))[0] END"""


def counts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and the columns of keep) with the counts that the rules read."""
    extra = keep or []
    word = f"[^{WS}]+"
    split = docs.select("doc_id", *extra, F.coalesce("text", F.lit("")).alias("_t")).select(
        "doc_id", *extra, "_t",
        F.regexp_extract_all("_t", F.lit(word), F.lit(0)).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{WS}]")).alias("_l"),
    )
    hashed = split.withColumn(
        "_h",
        F.expr("CASE WHEN size(_w) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END"),
    )
    return hashed.select(
        "doc_id", *extra,
        F.size("_w").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr(_repeat_words("_h")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.regexp_count("_t", F.lit("[.!?\u3002\uFF01\uFF1F\u061F\u0964]+")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        # From a word's first sign to its end is one match.
        F.regexp_count("_t", F.lit(f"{SYMBOLS}[^{WS}]*")).cast("long").alias("n_symbol_words"),
        # Words less those whose last sign before what closes them is no letter, or that have only such: tried at few places of a text.
        (F.size("_w") - F.regexp_count("_t", F.lit(rf"[^\p{{L}}{WS}](?<![^{WS}][{CLOSING}])[{CLOSING}]*+(?=[{WS}]|\z)"))).cast("long").alias("n_letter_ends"),
    )


def vote(rule: tuple[str, str]) -> Column:
    good, bad = rule
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def estimate(patterns: dict[tuple[int, ...], int], rules: int | None = None, rounds: int = 500) -> dict:
    """EM over the counts of vote patterns.

    Each rule has two rates: bad votes among good and among bad texts that it
    votes on. It starts from the majority of each pattern's votes. The priors
    are worth two votes a rule and two texts, whatever the corpus. Only the
    order of the two rates is held: where bad_on_good would exceed
    bad_on_bad, the rule tells nothing and both are its plain share of bad votes.
    """
    m = len(next(iter(patterns), ())) or rules or 0
    total = sum(patterns.values())
    chance = {v: min(0.99, max(0.01, 0.5 + 0.5 * sum(v) / max(1, sum(map(abs, v))))) for v in patterns}
    good, on_good, on_bad = 0.5, [0.025] * m, [0.25] * m
    for _ in range(rounds if total else 0):
        cast = [[0.0, 0.0] for _ in range(m)]  # votes on good, on bad texts
        bad = [[0.0, 0.0] for _ in range(m)]
        for votes, n in patterns.items():
            on = (n * chance[votes], n * (1 - chance[votes]))
            for j, v in enumerate(votes):
                for c in (0, 1):
                    cast[j][c] += on[c] if v else 0.0
                    bad[j][c] += on[c] if v < 0 else 0.0
        good = (sum(n * chance[v] for v, n in patterns.items()) + 1) / (total + 2)
        on_good = [(b[0] + 0.1) / (c[0] + 2) for b, c in zip(bad, cast, strict=True)]
        on_bad = [(b[1] + 1) / (c[1] + 2) for b, c in zip(bad, cast, strict=True)]
        for j in range(m):
            if on_good[j] > on_bad[j]:
                on_good[j] = on_bad[j] = (sum(bad[j]) + 1.1) / (sum(cast[j]) + 4)
        before, chance = chance, {v: posterior(v, good, on_good, on_bad) for v in patterns}
        if max(abs(before[v] - chance[v]) for v in patterns) < 1e-9:
            break
    return {"good": good, "bad_on_good": on_good, "bad_on_bad": on_bad}


def posterior(votes, good: float, on_good: list[float], on_bad: list[float]) -> float:
    z = math.log(good / (1 - good))
    for v, g, b in zip(votes, on_good, on_bad, strict=True):
        z += math.log(g / b) if v < 0 else math.log((1 - g) / (1 - b)) if v > 0 else 0.0
    return 1 / (1 + math.exp(-max(-700.0, z)))


def quality_rules(docs: DataFrame, rules: dict[str, tuple[str, str]] = RULES, threshold: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the counts, votes (one small int per rule),
    quality (posterior probability of a good text), base_failed, kept."""
    return _judged(docs, [], rules, threshold).select("doc_id", *COUNTS, "base_failed", "kept", "quality", *[f"vote_{k}" for k in rules])


def _judged(docs: DataFrame, keep: list[str], rules: dict[str, tuple[str, str]], threshold: float) -> DataFrame:
    table = Scratch(docs.sparkSession).written(counts(docs, keep), "rule-counts")
    names = [f"vote_{k}" for k in rules]
    voted = table.withColumns({n: vote(r) for n, r in zip(names, rules.values(), strict=True)})
    patterns = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).agg(F.count(F.lit(1))).collect()}  # 3 ** rules rows at most
    fit = estimate(patterns, len(names))
    z = F.lit(math.log(fit["good"] / (1 - fit["good"])))
    for n, g, b in zip(names, fit["bad_on_good"], fit["bad_on_bad"], strict=True):
        z = z + F.when(F.col(n) < 0, math.log(g / b)).when(F.col(n) > 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (
        voted.withColumn("quality", F.round(1 / (1 + F.exp(-z)), 9))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("quality") >= threshold))
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with their columns. Rows travel with their counts, so no text is joined or shuffled."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return _judged(rows, ["row"], RULES, 0.8).filter("kept").select("row.*")
