"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that any match
must contain (an AND of clauses, each an OR of trigram sets). The index lists, for each
trigram of those queries, the rows whose lower-cased text has it. Intersecting the lists gives
the candidate rows of a rule, which alone are searched with its expression. A rule without
mandatory trigrams is searched for in every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashFilter, join_counted, literal_table, running, table, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """`least`: characters that a match has at least; `value`: a group of at least `value_least`;
    `run`: the class of characters in which a match may begin anywhere, at the literal `begin`. If one
    place of a run fails, all later ones do, so runs are read from their start, once."""

    kind: str
    regex: str
    least: int = 0
    value: int = 0
    value_least: int = 0
    run: str = ""
    begin: str = ""


#: The base rules, then formats of well-known keys, in the order of their kinds.
WORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE = (
    Rule("assign", "(?i:(" + "|".join(WORDS) + r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", value=2, value_least=12),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]+", least=16),
)
RULES = (
    *BASE,
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("pay_key", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", run="[A-Za-z0-9_-]", begin="eyJ"),
)
MOST_STRINGS = 64

#: A query is a list of clauses, a clause a list of alternative trigram sets.
Query = list[list[frozenset[str]]]


def trigram_query(regex: str) -> Query:
    """What any match contains, lower-cased. Literal stretches (with classes and alternatives,
    as long as they stand for few strings) give a clause each; what repeats or varies more ends
    a stretch. An empty query asks for nothing."""
    try:
        from re import _parser as parser
    except ImportError:
        import sre_parse as parser
    clauses: Query = []

    def flush(strings: set[str]) -> None:
        if strings and all(len(s) >= 3 for s in strings):
            parts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
            # a set that includes another asks for nothing more
            clauses.append([p for p in sorted(parts, key=sorted) if not any(q < p for q in parts)])

    def exact(node) -> set[str] | None:
        """All strings of a node, lower-cased, or None for too many."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
            return {chr(x[1]).lower() for x in arg}
        if op == "SUBPATTERN":
            return exact_all(arg[3])
        if op == "BRANCH":
            found = [exact_all(x) for x in arg[1]]
            return None if None in found else set().union(*found)
        if op == "MAX_REPEAT" and arg[1] <= 1:
            one = exact_all(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def exact_all(nodes) -> set[str] | None:
        strings = {""}
        for node in nodes:
            more = exact(node)
            if more is None or len(strings) * len(more) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in more}
        return strings

    def walk(nodes) -> None:
        strings: set[str] = {""}
        for node in nodes:
            more = exact(node)
            if more is not None and len(strings) * len(more) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in more}
                continue
            flush(strings)
            strings = {""}
            if more is not None:
                strings = more
            elif str(node[0]) == "SUBPATTERN":
                walk(node[1][3])
            elif str(node[0]) == "MAX_REPEAT" and node[1][0] > 0:
                walk(node[1][2])
        flush(strings)

    walk(parser.parse(regex))
    return clauses


def _candidates(rows: DataFrame, rules: list[tuple[int, Query]]) -> DataFrame:
    """(row key, rules) by intersecting the lists of the trigram index."""
    spark = rows.sparkSession
    terms = [(r, c, a, t) for r, query in rules for c, clause in enumerate(query) for a, part in enumerate(clause) for t in sorted(part)]
    sizes = [(r, c, a, len(part)) for r, query in rules for c, clause in enumerate(query) for a, part in enumerate(clause)]
    trigrams = F.array(*[F.lit(t) for t in sorted({t[3] for t in terms})])
    # the text is folded once: a lambda's variable is computed before its body
    found = F.transform(F.array(F.lower("_text")), lambda text: F.filter(trigrams, lambda t: F.contains(text, t)))[0]
    postings = rows.select(F.explode(found).alias("_trigram"), "_id", "_hash")
    query = literal_table(spark, terms, ["_rule", "_clause", "_part", "_trigram"])
    size = literal_table(spark, sizes, ["_rule", "_clause", "_part", "_size"])
    clauses = literal_table(spark, [(r, len(q)) for r, q in rules], ["_rule", "_clauses"])
    # the rules' own tables are as small as the rules
    hits = postings.join(F.broadcast(query), "_trigram").groupBy("_id", "_hash", "_rule", "_clause", "_part").agg(F.count_distinct("_trigram").alias("_size"))
    whole = hits.join(F.broadcast(size), ["_rule", "_clause", "_part", "_size"])
    per_rule = whole.groupBy("_id", "_hash", "_rule").agg(F.count_distinct("_clause").alias("_clauses"))
    return per_rule.join(F.broadcast(clauses), ["_rule", "_clauses"]).groupBy("_id", "_hash").agg(F.collect_set("_rule").alias("_rules"))


def _spans(text: str, matches: str, number: int, rule: Rule) -> Column:
    """Spans (start, number, end, kind) of a rule's matches: the lengths of the pieces between
    the matches and of the matches, added up, give the offsets, in code points."""

    def placed(x: Column) -> Column:
        ends = running(F.transform(x["m"], lambda m, k: F.length(m) + F.length(F.get(x["p"], k))), lambda a, b: a + b, F.lit(0))
        before = lambda m: F.instr(m, rule.begin) - 1 if rule.run else F.lit(0)  # noqa: E731, of the run, not of the match
        made = F.zip_with(
            x["m"], ends, lambda m, e: F.struct((e - F.length(m) + before(m)).alias("start"), F.lit(number).alias("number"), e.alias("end"), F.lit(rule.kind).alias("kind"), m.alias("text"))
        )
        return F.transform(F.filter(made, good), lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"), s["kind"].alias("kind")))

    def good(span: Column) -> Column:
        long = F.length(span["text"]) >= rule.least
        return long & (F.length(F.regexp_extract(span["text"], rule.regex, rule.value)) >= rule.value_least) if rule.value else long

    pieces = F.struct(F.col(matches).alias("m"), F.split(F.col(text), F.lit(rule.regex), -1).alias("p"))
    return F.when(F.size(matches) > 0, F.transform(F.array(pieces), placed)[0])


EMPTY = "array<struct<start:int,number:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds `secret_spans`: array of (start, number, end, kind), by start, then by the rules' order.

    Offsets count code points, the end is exclusive. Of one kind, matches are those of a scan
    from the left without overlap, less those that are too short. A null text counts as empty
    and has no spans. Rows are told apart by id and text, so null and repeated ids are no
    matter, and repeated rows get the same spans. Texts of any length are searched whole, in
    time in proportion to their length and matches. All columns of `carry` (default: all) are
    kept; an input column `secret_spans` is replaced. An empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != "secret_spans"]
    rows = docs.select(
        F.struct(*carry).alias("_row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        text_or_empty(text_col).alias("_text"),
        F.xxhash64(text_or_empty(text_col)).alias("_hash"),
    )
    queries = [(k, trigram_query(r.regex)) for k, r in enumerate(rules)]
    indexed, full = [(k, q) for k, q in queries if q], [k for k, q in queries if not q]

    def search(texts: DataFrame, numbers: list[int], only: Column | None) -> DataFrame:
        for k in numbers:
            # too short runs are no matches of this form either: a run is taken whole
            regex = re.sub(r"\+$", "{%d,}" % rules[k].least, rules[k].regex) if k in full and rules[k].regex.count("+") == 1 and rules[k].regex.startswith("[") else rules[k].regex
            if rules[k].run:
                regex = f"(?<!{rules[k].run})(?:(?!{rules[k].begin}){rules[k].run})*+{regex}"
            found = F.regexp_extract_all("_text", F.lit(regex), F.lit(0))
            texts = texts.withColumn(f"_m{k}", found if only is None else F.when(F.array_contains("_rules", k), found).otherwise(F.array().cast("array<string>")))
            rule = replace(rules[k], regex=regex)
            texts = texts.withColumn(f"_s{k}", F.coalesce(_spans("_text", f"_m{k}", k, rule), F.array().cast(EMPTY)))
        return texts.withColumn("_spans", F.concat(*[f"_s{k}" for k in numbers]) if numbers else F.array().cast(EMPTY))

    scanned = search(rows, full, None).select("_row", "_id", "_hash", F.col("_spans").alias("_full_spans"))
    if not indexed:
        found = scanned.withColumn("_spans", F.array().cast(EMPTY))
    else:
        key = ["_id", "_hash"]
        candidates = written(_candidates(rows, indexed), "candidates")  # read three times
        chosen = HashFilter(candidates, key).mark(rows.select(*key, "_text"), key, "_maybe").where("_maybe")
        # rows that repeat id and text are one text, counted
        chosen = chosen.groupBy(*key).agg(F.first("_text").alias("_text"), F.count("*").alias("_n"))
        verified = search(chosen.join(candidates, key), [k for k, _ in indexed], F.col("_rules"))
        verified = verified.where(F.size("_spans") > 0).select(*key, "_n", "_spans")
        verified = written(verified, "verified")
        found = join_counted(scanned, verified, key, "_n", docs.count(), F.monotonically_increasing_id())
    both = F.array_sort(F.concat("_full_spans", F.coalesce("_spans", F.array().cast(EMPTY))))
    return found.select(*[F.col(f"_row.{c}").alias(c) for c in carry], both.alias("secret_spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["number"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    return found.select(
        "doc_id", *[count(k) for k in range(len(BASE))], F.sha2(_joined(F.filter(spans, lambda s: s["number"] < len(BASE))), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )


def _any_case(regex: str) -> str:
    """The expression for an engine whose case folding is wider than ASCII's."""
    head, _, rest = regex.partition("(?i:")
    if not rest:
        return regex
    inner, _, tail = rest.partition("))")
    return head + re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", inner) + ")" + tail


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.kind)}, {k}, {quote(_any_case(r.regex))}, {r.least}, {r.value_least})" for k, r in enumerate(RULES))
    return f"""
WITH rules(kind, number, re, least, value_least) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT row, kind, number, re, least, value_least,
         regexp_extract_all(t, re) AS m, string_split_regex(t, re) AS p
  FROM docs, rules WHERE regexp_matches(t, re)
), each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT row, kind, number, m[i] AS x,
         CAST(list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS start
  FROM each WHERE length(m[i]) >= least
    AND (value_least = 0 OR length(regexp_extract(m[i], {quote(_any_case(RULES[0].regex))}, 2)) >= value_least)
), per AS (
  SELECT row,
         count(*) FILTER (number = 0) AS a, count(*) FILTER (number = 1) AS b, count(*) FILTER (number = 2) AS c,
         string_agg(kind || ':' || start || ':' || (start + length(x)), ',' ORDER BY start, number) FILTER (number < 3) AS base,
         string_agg(kind || ':' || start || ':' || (start + length(x)), ',' ORDER BY start, number) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (row)
"""


OP5_SQL = _sql()


#: Code points in a block of a text that is cut: no piece is looked for in more of it.
BLOCK = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (by start) as its kind in angle brackets. Of overlapping spans
    the one that starts first counts, to the furthest end reached."""

    def merged(v: Column) -> Column:
        starts = F.filter(v["s"], lambda s, k: (k == 0) | (s["start"] >= F.get(v["to"], k - 1)))
        ends = F.filter(v["to"], lambda e, k: (k == F.size(v["to"]) - 1) | (F.get(v["s"], k + 1)["start"] >= e))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"), s["kind"].alias("kind")))

    def cut(v: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            def part(k: Column) -> Column:
                start = F.greatest(a - k * BLOCK, F.lit(0))
                return F.substring(F.get(v["blocks"], k), start + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - start)

            blocks = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
            return F.when(b > a, F.array_join(F.transform(blocks, part), "")).otherwise("")

        before = F.transform(v["s"], lambda s, k: F.concat(piece(F.coalesce(F.get(v["s"], k - 1)["end"], F.lit(0)), s["start"]), F.lit("<"), s["kind"], F.lit(">")))
        return F.concat(F.array_join(before, ""), piece(F.element_at(v["s"], -1)["end"], v["n"]))

    once = lambda x, f: F.transform(F.array(x), f)[0]
    whole = F.struct(spans.alias("s"), running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0)).alias("to"))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return once(F.struct(blocks.alias("blocks"), F.length(text).alias("n"), once(whole, merged).alias("s")), cut)


def secrets_stage(spark, docs, sf_dir):
    """Pipeline stage: each secret in a text is replaced by its kind in angle brackets.

    A text without secrets stays as it is, a null one too. Every row stays, repeated ones and
    those with a null id as well. An empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = find_secrets(docs.select("doc_id", "text", F.struct(*others).alias("_doc") if others else F.lit(None).alias("_doc")))  # columns may have the new names
    spans = F.col("secret_spans")
    text = F.when(F.size(spans) > 0, redacted(text_or_empty("text"), spans)).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*[F.col(f"_doc.{c}").alias(c) if c in others else c for c in docs.columns])
