"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how
far each is to be trusted, and a text stays if its posterior probability of being good is 1/2 or more.

Each rule looks at one measure of a text and votes good, bad, or not at all. The label is hidden;
of each label, a rule that votes at all votes good with a probability of its own, independently of
the other rules (a two-class model with missing votes). These probabilities and the share of good
texts are learned from the votes alone. The votes of a text are one of at most 3^11 patterns, so
each step of the learning is one sum over a table of counted patterns, whatever the number of texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

WINDOW = 8
LEAST_WORDS, MOST_REPEATS = 20, 30  # base rule: words of a text; percent of words in repeated windows
SYMBOLS = "#*$%&|<>"

#: Frequent function words of some languages. Fixed values.
FUNCTION_WORDS = (
    "the of and to in is that for it was with as on be at by this are or an "
    "der die und das den von zu mit des auf ist im dem nicht ein eine für als auch es "
    "le la les de des et du en un une que est pour dans qui au sur par plus pas "
    "el los las y del se por con una su para como al más o lo no"
).split()

#: Steps of the learning, and the change of a probability at which it ends.
STEPS, CHANGE = 60, 1e-4
#: What is believed before any vote is counted: votes of each label, as (good, bad).
BELIEF = {"good": (19.8, 0.2), "bad": (12.0, 8.0), "share": (16.0, 4.0)}
#: Of the good texts on which a rule votes, it calls such a share bad, at least and at most.
LEAST_BLAMED, MOST_BLAMED = 0.02, 0.03


def _size(x: str | Column) -> Column:
    return F.size(x).cast("long")


def _of(text: str, characters: str) -> Column:
    """How many of its characters are among `characters` (a class of a regular expression)."""
    return F.char_length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def _window_hashes(words: str) -> Column:
    """A hash of each window of 8 words, from those of halves: pairs, fours, eights."""
    def joined(step: int):
        return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h) - step), lambda a, b: F.xxhash64(a, b))

    out = F.col(words)
    for step in (1, 2, 4):
        out = _once(out, joined(step))
    return out


def _once(x: Column, f) -> Column:
    """f(x), with x computed a single time: a lambda's variable is computed before its body."""
    return F.transform(F.array(x), f)[0]


def measures(docs: DataFrame, text_col: str, carry: list[Column]) -> DataFrame:
    """`carry` and the measures of each text; words in repeated windows are exact: windows whose hash
    is not alone are compared by their words."""
    has_word = lambda line: F.rlike(line, F.lit("[^ \\t\\n\\x0B\\f\\r]"))
    rows = docs.select(*carry, text_or_empty(text_col).alias("_t"))
    rows = rows.select(
        "*",
        F.filter(F.split("_t", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), has_word).alias("_lines"),
        # capitals, digits, signs: little of most texts
        F.regexp_replace("_t", "[\\p{L}\\p{M} \\t\\n\\x0B\\f\\r&&[^\\p{Lu}]]+", "").alias("_rest"),
    )
    rows = rows.select("*", F.char_length(F.concat_ws("", "_w")).cast("long").alias("word_chars"), _of("_rest", "\\p{Lu}").alias("n_capitals"))
    rows = rows.select(
        "*",
        _of("_rest", SYMBOLS).alias("n_symbols"),
        _of("_rest", "!").alias("n_exclaims"),
        _of("_rest", ".!?").alias("n_ends"),
        (F.col("word_chars") - F.char_length("_rest") + F.col("n_capitals")).alias("n_letters"),
    )
    hashed = rows.select("*", F.when(F.size("_w") >= WINDOW, _window_hashes("_w")).otherwise(F.array()).alias("_h"))
    by_hash = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = hashed.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), by_hash).otherwise(F.array()).alias("_by_hash")).drop("_h")
    # windows whose hash stands beside its like; most texts have none
    twin = lambda of, key: lambda x, j: (x[key] == F.get(of, j - 1)[key]).eqNullSafe(True) | (x[key] == F.get(of, j + 1)[key]).eqNullSafe(True)
    rows = rows.select("*", F.filter("_by_hash", twin(F.col("_by_hash"), "h")).alias("_again")).drop("_by_hash")
    words_of = lambda x: F.struct(F.concat_ws(" ", F.slice("_w", x["i"] + 1, WINDOW)).alias("s"), x["i"].alias("i"))
    rows = rows.select("*", F.sort_array(F.transform("_again", words_of)).alias("_by_words")).drop("_again")
    starts = F.sort_array(F.transform(F.filter("_by_words", twin(F.col("_by_words"), "s")), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.select(
        *[F.col(c) for c in rows.columns if c not in ("_t", "_w", "_lines", "_rest", "_by_words")],
        _size("_w").alias("n_words"),
        _size("_lines").alias("n_lines"),
        (_size("_lines") - _size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _size(F.filter("_w", lambda w: w.isin(FUNCTION_WORDS))).alias("n_function_words"),
        _size(F.filter("_w", lambda w: ~F.rlike(w, F.lit("\\p{L}")))).alias("n_no_letter"),
        _size(F.filter("_w", lambda w, i: (w == F.get("_w", i - 1)).eqNullSafe(True))).alias("n_echoes"),
    )


def rules() -> dict[str, Column]:
    """Votes by name: true for good, false for bad, null for none. A text without words gets none."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(F.col("n_words") > 0, F.when(bad, False).when(good, True))

    per_word = lambda c: F.col(c) / F.col("n_words")
    of_chars = lambda c: F.col(c) / F.col("word_chars")
    long = F.col("n_words") >= 50
    return {
        "length": vote(F.col("n_words") >= 50, F.col("n_words") < 10),
        "word_length": vote(per_word("word_chars").between(3, 10), (per_word("word_chars") < 2) | (per_word("word_chars") > 20)),
        "symbols": vote(per_word("n_symbols") < 0.02, per_word("n_symbols") > 0.1),
        "letters": vote(of_chars("n_letters") >= 0.9, of_chars("n_letters") < 0.7),
        "capitals": vote(F.col("n_capitals") < 0.15 * F.col("n_letters"), F.col("n_capitals") > 0.4 * F.col("n_letters")),
        "words_of_letters": vote(per_word("n_no_letter") < 0.05, per_word("n_no_letter") > 0.25),
        "exclaiming": vote(per_word("n_exclaims") < 0.05, per_word("n_exclaims") > 0.2),
        "sentences": vote(long & per_word("n_ends").between(0.02, 0.3), long & ~per_word("n_ends").between(0.004, 0.6)),
        "function_words": vote(per_word("n_function_words") >= 0.1, F.lit(False)),
        "echoes": vote(per_word("n_echoes") < 0.02, per_word("n_echoes") > 0.2),
        # lines and windows that repeat are often the same, so they have one vote
        "repeats": vote(
            long & (per_word("n_repeat_words") < 0.05) & (F.col("n_dup_lines") < 0.1 * F.col("n_lines")),
            (per_word("n_repeat_words") > 0.2) | (F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        ),
    }


def log_odds(votes: str, p: dict, share: float, names: list[str]) -> Column:
    """Log odds of good from an array of votes (1 good, -1 bad, 0 none), in the order of `names`."""
    weights = []
    for name in names:
        good, bad = p["good", name], p["bad", name]
        weights.append(F.struct(F.lit(math.log(good / bad)).alias("yes"), F.lit(math.log((1 - good) / (1 - bad))).alias("no")))
    each = F.zip_with(votes, F.array(*weights), lambda v, w: F.when(v > 0, w["yes"]).when(v < 0, w["no"]).otherwise(0.0))
    return F.aggregate(each, F.lit(math.log(share / (1 - share))), lambda a, x: a + x)


def posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def learn(votes: DataFrame, column: str, names: list[str]) -> tuple[dict, float]:
    """(probability that a rule which votes says good, by (label, rule); share of good texts), by
    expectation-maximisation over the counted patterns of votes.

    Rules are made so that they seldom blame a good text: of good texts from LEAST_BLAMED to MOST_BLAMED
    of a rule's votes are bad. So a text of which several rules say bad is no odd kind of good text, a
    single bad vote is no proof, and the labels cannot change places. BELIEF counts as some texts more, so that no probability is 0 or 1.
    """
    patterns = written(votes.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")).coalesce(1), "votes")
    p = {(label, name): BELIEF[label][0] / sum(BELIEF[label]) for label in ("good", "bad") for name in names}
    share = BELIEF["share"][0] / sum(BELIEF["share"])
    sums = [
        F.sum(F.when(F.get("_v", j) == said, F.col(label)).otherwise(0.0)).alias(f"{label}_{name}_{said}")
        for label in ("good", "bad") for j, name in enumerate(names) for said in (1, -1)
    ]
    for _ in range(STEPS):
        weighed = patterns.select("_v", "_n", posterior(log_odds("_v", p, share, names)).alias("_q"))
        weighed = weighed.select("_v", (F.col("_n") * F.col("_q")).alias("good"), (F.col("_n") * (1 - F.col("_q"))).alias("bad"))
        found = weighed.agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), *sums).first().asDict()
        new = {}
        for label, name in p:
            yes, no = (found[f"{label}_{name}_{said}"] or 0.0 for said in (1, -1))
            new[label, name] = (yes + BELIEF[label][0]) / (yes + no + sum(BELIEF[label]))
        for name in names:
            new["good", name] = min(max(new["good", name], 1 - MOST_BLAMED), 1 - LEAST_BLAMED)
            new["bad", name] = min(new["bad", name], new["good", name])
        good, bad = found["all_good"] or 0.0, found["all_bad"] or 0.0
        at, share = share, (good + BELIEF["share"][0]) / (good + bad + sum(BELIEF["share"]))
        moved = max(abs(at - share), *[abs(new[k] - p[k]) for k in p])
        p = new
        if moved < CHANGE:
            break
    return p, share


def quality_verdicts(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row a document: the columns `carry` (default: all), the measures, the votes (a map rule -> good or
    not; rules that abstain are left out), base_failed, the posterior probability `good`, and kept.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATS percent of them in windows
    of 8 words found twice or more. kept: not base_failed, and good >= 1/2. A null text counts as
    empty: no word, no vote, base_failed. Rows that repeat are judged alike; texts of any length are measured whole. An
    empty table gives no rows. Input columns may have any names.
    """
    carry = docs.columns if carry is None else carry
    rows = measures(docs, text_col, [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")])
    made = rules()
    names = list(made)
    measured = [c for c in rows.columns if c != "_row"]
    vote = lambda v: F.when(v, 1).when(~v, -1).otherwise(0).cast("tinyint")
    rows = written(rows.select("_row", *measured, F.array(*[vote(v) for v in made.values()]).alias("_v")), "measures")
    odds = log_odds("_v", *learn(rows, "_v", names), names)
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATS * n)
    cast = F.filter(F.arrays_zip(F.array(*[F.lit(k) for k in names]).alias("rule"), F.col("_v").alias("vote")), lambda v: v["vote"] != 0)
    votes = F.map_from_entries(F.transform(cast, lambda v: F.struct(v["rule"], v["vote"] > 0)))
    return rows.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in carry], *measured, votes.alias("votes"), failed.alias("base_failed"),
        posterior(odds).alias("good"), (~failed & (odds >= 0)).alias("kept"),
    )


def op13_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_verdicts(docs, carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
