"""Personal data: base patterns, and further spans that weakly supervised labelers agree on."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, settle
from .spans import no_spans, of_kind, spans, written

KINDS = ("email", "ip", "card", "phone")

# Patterns, gazetteers and cue words. Possessive quantifiers and the
# guards at the start change no match; they keep long runs of characters linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT_EMAIL = r"[A-Za-z0-9._%+-]++\x20?+[\[(]at[\])]\x20?+[A-Za-z0-9-]++(?:\x20?+[\[(]dot[\])]\x20?+[A-Za-z0-9-]++)++"
SPACED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20++@\x20*+[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SPELT_IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?+[\[(](?:\.|dot)[\])]\x20?+[0-9]{1,3}){3}(?![0-9])"
GROUPED_CARD = r"(?<![0-9])(?:[0-9]{4}(?:[\x20._/-]?[0-9]{4}){3}|3[47][0-9]{2}[\x20._/-]?[0-9]{6}[\x20._/-]?[0-9]{5})(?![0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?+|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])"
LONG_PHONE = r"(?<![0-9A-Za-z+().-])00[1-9][0-9]{0,2}(?:[\x20./-]?\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z.-])"
GROUPED_PHONE = r"(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"
TOP_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us"
ISSUERS = "3[0-9]|4|5[1-5]|2[2-7]|6"
CUES = ("e-?mail|contact|write|reach", "ip|host|server|address|login", "card|visa|mastercard|amex|credit|payment", "call|phone|tel|fax|mobile|cell")
COUNTER_CUES = "order|invoice|version|serial|part|isbn|build|ticket|release|section"
#: Characters before a span that the context labeler and the classifier read.
CONTEXT = 40
#: Probability from which the classifier adds a span.
ACCEPT = 0.9
LABELERS = ("pattern", "check", "gazetteer", "context")
#: Where the rates of all labelers start, and how many spans that counts for.
PRIOR_RATE, PRIOR_SPANS = 0.85, 4
#: What the classifier knows of a span and its surroundings; each has a few values for each kind.
FEATURES = ("before", "after", "digits", "separators", "first", "sound", "cue")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    turned = F.reverse(_digits(hit))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """E-mail addresses, IPv4 addresses, payment cards and international phone numbers."""
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    number = lambda s: F.length(_digits(s["hit"]))
    emails = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0))
    ips = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(spans(text, IP, 1), lambda s: s["hit"].rlike(rf"^{octet}(?:\.{octet}){{3}}$")))
    cards = F.when(text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), F.filter(spans(text, CARD, 2), lambda s: F.when(number(s).between(14, 19), _luhn(s["hit"])).otherwise(False)))
    phones = F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, 3), lambda s: number(s).between(10, 15)))
    return F.concat(*[F.coalesce(x, no_spans()) for x in (emails, ips, cards, phones)])


def loose_spans(text: Column, base: Column) -> Column:
    """Further candidates of all four kinds: spelt-out and oddly grouped ones, and matches of the base patterns that fail their checks.

    None overlaps a base span; of two that overlap the one of the earlier kind stays, or the earlier one.
    """
    digits = lambda s: F.length(_digits(s["hit"]))
    found = [
        F.when(text.rlike(r"[\[(]dot[\])]"), spans(text, SPELT_EMAIL, 0)),
        F.when(F.contains(text, F.lit(" @")), spans(text, SPACED_EMAIL, 0)),
        F.when(text.rlike(r"[0-9]\x20?[\[(](?:\.|dot)[\])]"), spans(text, SPELT_IP, 1)),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), spans(text, IP, 1)),
        F.when(text.rlike(r"[0-9]{4}[\x20._/-]?[0-9]{4,6}[\x20._/-]?[0-9]{4}"), spans(text, GROUPED_CARD, 2)),
        F.when(text.rlike(r"[0-9](?:[\x20-]?+[0-9]){13}"), F.filter(spans(text, CARD, 2), lambda s: digits(s).between(14, 19))),
        F.when(text.rlike(r"[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}"), spans(text, LOCAL_PHONE, 3)),
        F.when(text.rlike(r"(?<![0-9])00[1-9]"), spans(text, LONG_PHONE, 3)),
        F.when(F.contains(text, F.lit("+")), spans(text, GROUPED_PHONE, 3)),
        F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, 3), lambda s: digits(s).between(7, 18))),
    ]
    every = F.concat(*[F.coalesce(x, no_spans()) for x in found])
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = F.filter(every, lambda s: ~F.exists(base, lambda b: meets(b, s)))
    one = F.aggregate(
        F.array_sort(F.transform(apart, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))),
        no_spans(),
        lambda kept, s: F.when(F.exists(kept, lambda k: meets(k, s)), kept).otherwise(F.concat(kept, F.array(s))),
    )
    return F.when(F.size(every) > 0, one).otherwise(no_spans())


def _class(c: Column) -> Column:
    return F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").otherwise("mark")


def voted(text: Column, found: Column, base: bool) -> Column:
    """Each span with the votes of the labelers (1 yes, -1 no, 0 abstains) and the classifier's features."""
    vote = lambda c: F.when(c, 1).otherwise(-1)

    def of(s: Column) -> Column:
        kind, hit = s["kind"], s["hit"]
        begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.substring(text, begin + 1, s["start"] - begin)
        before, number = F.lower(near), _digits(hit)
        octets = F.filter(F.split(F.regexp_replace(hit, "[^0-9]+", "."), r"\."), lambda x: x != "")
        bare = (kind == 2) & hit.rlike("^[0-9]+$")  # a run of digits has no form that tells
        plain = F.when(bare, 0).otherwise(1) if base else (
            F.when(bare, 0)
            .when(kind == 0, vote(hit.rlike(rf"^(?:{SPELT_EMAIL})$")))
            .when(kind == 1, vote(hit.rlike(rf"^(?:{SPELT_IP})$")))
            .when(kind == 2, vote(hit.rlike(r"^(?:[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}([\x20.-]?)[0-9]{6}\2[0-9]{5})$")))
            .otherwise(vote(hit.rlike(rf"^{GROUPED_PHONE}$") | hit.rlike(r"^(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}([\x20.-]))[0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}[\x20./-]?[0-9()\x20./-]{6,})$")))
        )
        sound = (
            F.when(kind == 0, F.lower(hit).rlike(r"[a-z]{2,6}$"))
            .when(kind == 1, F.forall(octets, lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255)))
            .when(kind == 2, _luhn(hit))
            .otherwise(F.length(number).between(10, 15))
        )
        local = (kind == 3) & ~hit.rlike(r"^(?:\+|00)[1-9]")  # without a country code there is nothing to check
        listed = (
            F.when(kind == 0, F.lower(hit).rlike(rf"(?:\.|[\[(]dot[\])]\x20?)(?:{TOP_DOMAINS})$"))
            .when(kind == 1, ~hit.rlike(r"^(?:0|127|255)[^0-9]"))
            .when(kind == 2, number.rlike(rf"^(?:{ISSUERS})"))
            .otherwise(~local | number.rlike("^[2-9][0-9]{2}[2-9]"))
        )
        own, other = F.lit(False), F.lit(False)
        for k, words in enumerate(CUES):
            cued = before.rlike(rf"\b(?:{words})")
            own, other = own | ((kind == k) & cued), other | ((kind != k) & cued)
        counter = before.rlike(rf"\b(?:{COUNTER_CUES})[^a-z]*$")
        context = F.when(counter, -1).when(own, 1).otherwise(0)
        marks = F.array_sort(F.array_distinct(F.split(F.regexp_replace(F.when(kind == 0, F.regexp_replace(hit, "[A-Za-z0-9._%+-]", "")).otherwise(hit), "[0-9A-Za-z]", ""), "")))
        marks = F.filter(marks, lambda x: x != "")
        features = (
            _class(F.substring(near, -1, 1)),
            _class(F.substring(text, s["end"] + 1, F.lit(1))),
            F.when(kind == 0, F.lit(0)).otherwise(F.least(F.length(number), F.lit(20))).cast("string"),
            F.when(F.size(marks) > 1, "several").when(F.size(marks) == 0, "none").otherwise(F.element_at(F.concat(marks, F.array(F.lit(""))), 1)),
            F.when(kind == 0, "letter").otherwise(F.substring(number, 1, 1)),
            sound.cast("string"),
            F.when(counter, "counter").when(own, "own").when(other, "other").otherwise("none"),
        )
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
            plain.alias("pattern"), F.when(local, 0).otherwise(vote(sound)).alias("check"), F.when(local & listed, 0).otherwise(vote(listed)).alias("gazetteer"), context.alias("context"),
            *[f.alias(name) for f, name in zip(features, FEATURES, strict=True)],
        )

    return F.transform(found, of)


def reliabilities(patterns: list[tuple], rounds: int = 100) -> tuple[dict[tuple, float], dict[tuple[int, int], tuple[float, float]]]:
    """Expectation-maximisation over counts of votes: the posterior of each pattern of votes, and how reliable each labeler is.

    ``patterns``: (kind, one vote for each of LABELERS, count). For each kind a labeler
    has a rate of yes among the true spans on which it votes and a rate of no among the
    others; a vote of 0 says nothing. Each kind has its share of true spans. All start
    from PRIOR_RATE and an even share, which count as much as PRIOR_SPANS spans.
    """
    kinds, labelers = sorted({p[0] for p in patterns}), range(len(LABELERS))
    rates = {(k, i): (PRIOR_RATE, PRIOR_RATE) for k in kinds for i in labelers}
    share = dict.fromkeys(kinds, 0.5)
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, *votes, _n in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            for i, vote in enumerate(votes):
                yes, no = rates[kind, i]
                odds += math.log(yes / (1 - no)) if vote > 0 else math.log((1 - yes) / no) if vote < 0 else 0
            post[kind, *votes] = 1 / (1 + math.exp(-max(-700, min(700, odds))))
        for kind in kinds:
            mine = [(p[1:-1], p[-1] * post[p[:-1]], p[-1] * (1 - post[p[:-1]])) for p in patterns if p[0] == kind]
            for i in labelers:
                yes = sum(t for v, t, _ in mine if v[i] > 0) + PRIOR_SPANS * PRIOR_RATE
                no = sum(f for v, _, f in mine if v[i] < 0) + PRIOR_SPANS * PRIOR_RATE
                rates[kind, i] = yes / (sum(t for v, t, _ in mine if v[i]) + PRIOR_SPANS), no / (sum(f for v, _, f in mine if v[i]) + PRIOR_SPANS)
            share[kind] = (sum(t for _, t, _ in mine) + PRIOR_SPANS / 2) / (sum(p[-1] for p in patterns if p[0] == kind) + PRIOR_SPANS)
    return post, rates


def names_of(kind: int, values: tuple) -> list[str]:
    """The classifier's features of a span: its kind, and each value for this kind."""
    return [f"{kind}", *(f"{kind}/{name}={value}" for name, value in zip(FEATURES, values, strict=True))]


def train(rows: list[tuple], steps: int = 400, rate: float = 0.1, ridge: float = 0.5) -> dict[str, float]:
    """Weights of a logistic classifier by feature, from (kind, features, posterior, count) rows: the posteriors are its soft labels.

    It sees no vote, so it carries over to spans on which labelers abstain or err. The
    ridge counts as much as so many spans would; a feature that no span has weighs nothing.
    """
    names = sorted({f for kind, values, _, _ in rows for f in names_of(kind, values)})
    if not names:
        return {}
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (kind, values, _, _) in enumerate(rows):
        x[i, [place[f] for f in names_of(kind, values)]] = 1
    y, n = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (x.T @ (n * (p - y)) + ridge * w) / n.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return dict(zip(names, w.tolist(), strict=True))


def find_pii(docs: DataFrame) -> DataFrame:
    """Finds personal data in every whole text of ``docs`` (doc_id, text).

    Returns doc_id, and base and found, arrays of (kind, start, end) by code points;
    base holds the matches of the base patterns, found these and the added ones.

    Labelers (pattern, checksum or range, gazetteer, context) vote yes or no on every
    candidate, base spans included. Votes and features of the whole corpus are counted
    by their combinations, which the few values of each bound and not the corpus;
    expectation-maximisation on the counts estimates how reliable each labeler is, and
    a logistic classifier over the features of a span and its surroundings learns from
    its posteriors. It alone decides, as an expression, which candidates outside the
    base patterns are added. Added spans never overlap base ones or each other.

    Null texts count as empty and have no spans. Null doc_ids and repeated rows keep a
    row each. Further columns, of any name, are ignored. An empty table gives an empty
    result. Very long texts are read whole; possessive patterns keep them linear.
    """
    return _judged(pick(docs, "doc_id", "text"), "doc_id")


def _judged(texts: DataFrame, keep: str) -> DataFrame:
    """(keep, base, found) of each row of ``texts`` (keep, text)."""
    text = F.coalesce("text", F.lit(""))
    seen = texts.withColumn("base", base_spans(text))
    seen = seen.withColumn("loose", loose_spans(text, F.col("base")))
    seen = seen.select(keep, F.concat(voted(text, F.col("base"), True), voted(text, F.col("loose"), False)).alias("voted"))
    seen, _ = settle(seen, "votes")
    columns = ("kind", *LABELERS, *FEATURES)
    counted = seen.where(F.size("voted") > 0).select(F.explode("voted").alias("v")).groupBy(*[F.col(f"v.{c}") for c in columns]).count()
    rows = sorted(tuple(r) for r in counted.collect())
    votes: dict[tuple, int] = {}
    for r in rows:
        votes[r[: len(LABELERS) + 1]] = votes.get(r[: len(LABELERS) + 1], 0) + r[-1]
    post, _ = reliabilities([(*p, n) for p, n in sorted(votes.items())])
    weights = train([(r[0], r[len(LABELERS) + 1 : -1], post[r[: len(LABELERS) + 1]], r[-1]) for r in rows])
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def likely(v: Column) -> Column:
        kind = v["kind"].cast("string")
        names = [kind, *(F.concat(kind, F.lit(f"/{name}="), v[name]) for name in FEATURES)]
        return sum((F.coalesce(F.element_at(table, name), F.lit(0.0)) for name in names[1:]), F.coalesce(F.element_at(table, names[0]), F.lit(0.0))) >= math.log(ACCEPT / (1 - ACCEPT))

    plain = lambda v: F.struct(v["kind"].alias("kind"), v["start"].alias("start"), v["end"].alias("end"))
    return seen.select(
        keep,
        F.transform(F.filter("voted", lambda v: v["base"]), plain).alias("base"),
        F.transform(F.filter("voted", lambda v: v["base"] | likely(v)), plain).alias("found"),
    )


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def step(seen: Column, s: Column) -> Column:
        gap = F.substring(text, seen["at"] + 1, s["start"] - seen["at"])
        added = F.concat(seen["out"], gap, F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), F.when(s["start"] >= seen["at"], added).otherwise(seen["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(ordered, zero, step, lambda seen: F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.char_length(text)))))


def redact_rows(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (text and others, of any name, also twice), with spans of personal data replaced in the text.

    Null texts stay null, repeated rows keep a row each, an empty table stays empty.
    """
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = _judged(plain.select(F.struct("*").alias("row"), F.col(f"c{at}").alias("text")), "row")
    columns = [F.col(f"row.c{i}") for i in range(len(docs.columns))]
    columns[at] = redacted(columns[at], F.col("found"))
    return found.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).toDF(*docs.columns)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        *[of_kind(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"),
        written(F.col("found"), KINDS).alias("spans"),
    )


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_pii returns of the base patterns alone, which SQL can express."""
    return op4_pii(spark, sf_dir).drop("spans")


BASE_SQL = r"""
WITH k(kind, name, pat) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')
), h AS (
  SELECT doc_id, kind, name, regexp_extract_all(x, pat) AS hits, regexp_split_to_array(x, pat) AS gaps
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents), k WHERE regexp_matches(x, pat)
), s AS (
  SELECT doc_id, kind, name, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
         list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(g) for g in hits[1:i - 1]]), 0) AS b
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)
), t AS (
  SELECT *, list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT) ELSE 2 * CAST(reverse(digits)[i] AS INT) - CASE WHEN reverse(digits)[i] > '4' THEN 9 ELSE 0 END END for i in range(1, length(digits) + 1)]) AS luhn
  FROM s
), f AS (
  SELECT doc_id, kind, name, CAST(b AS BIGINT) AS b, CAST(b + length(hit) AS BIGINT) AS e FROM t
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN regexp_full_match(hit, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}')
    WHEN 2 THEN length(digits) BETWEEN 14 AND 19 AND luhn % 10 = 0
    ELSE length(digits) BETWEEN 10 AND 15 END
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
         string_agg(name || ':' || b || ':' || e, ',' ORDER BY b, kind) AS base
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""
