"""Secret scan: a trigram inverted index picks the texts on which a rule's pattern runs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, pick, settle
from .spans import of_kind, spans, written

try:
    from re import _constants as sre_constants
    from re import _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants
    import sre_parse

#: Exact strings of a pattern's part that a trigram query may list; a larger set says nothing.
MOST_STRINGS = 64
#: Candidate texts (their keys and rules, some 100 MB) up to which they are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of one of its groups (0: the whole match)."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules and two added ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"ghp_[A-Za-z0-9]{36}"),
)
BASE = 3
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: What Java and Python read alike; other constructs of a pattern are refused, since its trigrams might not be mandatory then.
_ALIKE = {"LITERAL", "NOT_LITERAL", "IN", "ANY", "SUBPATTERN", "BRANCH", "MAX_REPEAT", "MIN_REPEAT", "AT"}


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Boolean trigram query of a pattern: an AND of ORs of ANDs, trigrams with A-Z in lower case.

    Each outer element stands for one stretch of the pattern whose strings are known:
    some one of its alternatives must occur, that is all trigrams of the alternative.
    An empty query means that no trigram is mandatory.
    """
    query: list[list[frozenset[str]]] = []
    parsed = sre_parse.parse(pattern)
    _require_plain(parsed, pattern)

    def close(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            query.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])

    def exact(node) -> set[str] | None:
        op, arg = node
        if op is sre_constants.LITERAL:
            return {chr(arg).translate(_ASCII_LOWER)}
        if op is sre_constants.SUBPATTERN:
            return whole(arg[3])
        if op is sre_constants.BRANCH:
            parts = [whole(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is sre_constants.MAX_REPEAT and arg[1] <= 2:
            part = whole(arg[2])
            return None if part is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(part, repeat=n)}
        return None

    def whole(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            part = exact(node)
            if part is None or len(out) * len(part) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            part = exact(node)
            if part is not None and len(run) * len(part) <= MOST_STRINGS:
                run = {a + b for a in run for b in part}
                continue
            close(run)
            run = {""}
            if node[0] is sre_constants.SUBPATTERN:
                walk(node[1][3])
            elif node[0] is sre_constants.MAX_REPEAT and node[1][0] >= 1:
                walk(node[1][2])
        close(run)

    walk(parsed)
    return query


def _require_plain(nodes, pattern: str) -> None:
    """Refuses constructs that Java's and Python's patterns don't share."""
    for op, arg in nodes:
        if str(op) not in _ALIKE:
            raise ValueError(f"{pattern!r} has {op}, which the trigram query doesn't know")
        if op is sre_constants.SUBPATTERN:
            _require_plain(arg[3], pattern)
        elif op is sre_constants.BRANCH:
            for part in arg[1]:
                _require_plain(part, pattern)
        elif op in (sre_constants.MAX_REPEAT, sre_constants.MIN_REPEAT):
            _require_plain(arg[2], pattern)


def text_key(text: Column) -> Column:
    """Key by which rows meet what was found in equal texts."""
    return F.xxhash64(text)


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the rules whose trigram query holds on a text; texts without any have no row."""
    spark = texts.sparkSession
    terms = [(r.name, s, a, t, len(alt)) for r in rules for s, alts in enumerate(trigram_query(r.pattern)) for a, alt in enumerate(alts) for t in sorted(alt)]
    segments = {r.name: len(trigram_query(r.pattern)) for r in rules}
    wanted = sorted({t[3] for t in terms})
    if not wanted:
        return spark.createDataFrame([], "key long, rules array<string>")
    low = ascii_lower(F.col("text"))
    held = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.contains(F.col("low"), t))
    postings = texts.select("key", low.alias("low")).select(F.explode(held).alias("trigram"), "key").distinct()
    # One row for each trigram of the rules: the rules bound it, not the corpus.
    listed = spark.createDataFrame(terms, "rule string, segment int, alternative int, trigram string, size int")
    met = postings.join(F.broadcast(listed), "trigram").groupBy("key", "rule", "segment", "alternative", "size").agg(F.count("*").alias("n")).where("n = size")
    needs = F.create_map(*[F.lit(x) for r in sorted(segments) if segments[r] for x in (r, segments[r])])
    full = met.groupBy("key", "rule").agg(F.count_distinct("segment").alias("n")).where(F.col("n") == F.element_at(needs, F.col("rule")))
    return full.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _long_enough(rule: Rule):
    return lambda s: F.char_length(F.regexp_extract(s["hit"], rule.pattern, rule.group)) >= rule.least


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Finds secrets in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, text and found, an array of (kind, start, end, hit), kind being
    the rule's place in ``rules``. A rule with mandatory trigrams runs only on texts
    for which the posting lists of its Boolean query intersect; a rule without any
    runs on all. Matches are leftmost and non-overlapping for each rule, those
    shorter than the rule asks are dropped without another try.

    Null texts count as empty and have no spans. Null doc_ids, repeated rows and equal
    texts keep a row each. Further columns, of any name, are ignored. An empty table
    gives an empty result. Very long texts are read whole. Texts aren't shuffled while
    no more than BROADCAST_KEYS different ones are candidates.
    """
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", text_key(F.col("text")))
    # As a table of its own, so that Spark can split the copies of one text over several tasks of the join.
    chosen, _ = settle(candidates(texts, rules).select(F.col("key").alias("their"), "rules"), "candidates")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen.hint("merge")
    rows = texts.join(chosen, F.col("key") == F.col("their"), "left")
    text = F.col("text")
    found = []
    for kind, rule in enumerate(rules):
        hits = spans(text, rule.pattern, kind)
        if rule.least:
            hits = F.filter(hits, _long_enough(rule))
        if trigram_query(rule.pattern):
            hits = F.when(F.array_contains("rules", rule.name), hits)
        else:
            hits = F.when(text.rlike(rule.pattern), hits)
        found.append(F.coalesce(hits, F.array().cast("array<struct<kind:int,start:int,end:int,hit:string>>")))
    return rows.select("doc_id", "text", F.concat(*found).alias("found"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tuple(r.name for r in RULES)
    rows = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["kind"] < BASE)
    return rows.select(
        "doc_id",
        *[of_kind(F.col("found"), k).alias(f"n_{kinds[k]}") for k in range(BASE)],
        F.sha2(written(base, kinds), 256).alias("base_sha256"),
        written(F.col("found"), kinds).alias("spans"),
    )


_PEM, _GITHUB = (r.pattern for r in RULES[BASE:])
#: ASCII letters in either case are written out: a pattern's own flag would take further characters for them.
OP6_SQL = rf"""
WITH k(kind, name, pat, part, least) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', '[0-9a-f]{{24,}}', 0, 24), (3, 'pem', '{_PEM}', 0, 0), (4, 'github', '{_GITHUB}', 0, 0)
), h AS (
  SELECT doc_id, kind, name, pat, part, least, regexp_extract_all(x, pat) AS hits, regexp_split_to_array(x, pat) AS gaps
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents), k WHERE regexp_matches(x, pat)
), s AS (
  SELECT doc_id, kind, name, part, least, pat, hits[i] AS hit,
         list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(g) for g in hits[1:i - 1]]), 0) AS b
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)
), f AS (
  SELECT doc_id, kind, name, CAST(b AS BIGINT) AS b, CAST(b + length(hit) AS BIGINT) AS e
  FROM s WHERE length(CASE part WHEN 2 THEN regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END) >= least
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) FILTER (kind < {BASE}) AS base, string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind, e) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g USING (doc_id)
"""
