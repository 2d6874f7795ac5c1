"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from four strict patterns with checks and always stay. Looser patterns
propose further spans. Regex, gazetteer and context labelers vote on every candidate;
expectation-maximisation over the counts of vote patterns (at most kinds x 3^labelers rows)
estimates how reliable each labeler is, and its posteriors train a logistic classifier over
votes and shapes that decides about the proposed spans.

A null text is empty and has no spans. Rows are independent, repeated ones give repeated
results. Offsets count code points, ends are exclusive. An empty table gives an empty
result; without candidates the classifier keeps its prior weights."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.storage import written

# Possessive forms of the base patterns: they match the same spans without deep recursion,
# and never look twice at a run of characters that cannot match. "\G" is the last match's end.
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
SPELLED_EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++"
                 r"(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++")
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"

KINDS = ("email", "ip", "card", "phone", "secret")
# (kind, strict, pattern, cheap test that a text can hold one: it has one of these strings)
PATTERNS = (
    ("email", True, EMAIL, "@"), ("ip", True, IP, "."), ("card", True, CARD, None),
    ("phone", True, PHONE, "+"), ("phone", False, LOCAL_PHONE, None),
    ("email", False, SPELLED_EMAIL, "at|AT"), ("secret", False, SECRET, None),
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
BEFORE, AFTER = 32, 12

# Fixed word lists of the gazetteer and context labelers.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl")
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write to", "kontakt"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "appel", "anruf", "llam"),
    "secret": ("token", "key", "secret", "passw", "auth", "bearer", "credential"),
}
AGAINST = ("version", "isbn", "issn", "page", "license", "section", "figure", "chapter", "http")
LABELERS = ("regex", "gazetteer", "context", "counter", "border")
SHAPES = ("long", "mixed", "hex", "assigned")


def _candidates(text: str) -> tuple[list[tuple[str, Column]], Column]:
    """Columns of pieces between matches, and an array of all matches with their gaps."""
    pieces, found = [], []
    digits = F.col("_digits")
    for n, (kind, strict, pattern, needs) in enumerate(PATTERNS):
        possible = digits if needs is None else reduce(or_, map(F.col(text).contains, needs.split("|")))
        if needs == ".":
            possible = possible & digits
        possible = F.coalesce(possible, F.lit(False))
        pieces.append((f"_p{n}", F.when(possible, F.split(text, pattern, -1))))
        pieces.append((f"_m{n}", F.when(F.size(f"_p{n}") > 1,
                                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))
        found.append(F.expr(f"""coalesce(transform(_m{n}, (m, i) -> struct({n} AS pattern, i AS place,
            length(_p{n}[i]) AS gap, m AS match, right(_p{n}[i], {BEFORE}) AS before,
            left(_p{n}[i + 1], {AFTER}) AS after)), array())"""))
    return pieces, F.concat(*found)


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per match of any pattern, with offsets; rows without a match give one null."""
    df = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                   F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    pieces, found = _candidates("_text")
    for name, column in pieces:
        df = df.withColumn(name, column)
    rows = df.select("_row", "_key", F.xxhash64("_text").alias("_hash"), F.explode_outer(found).alias("c"))
    rows = rows.select("_row", "_key", "_hash", "c.*").repartition("_row")
    each = Window.partitionBy("_row", "pattern").orderBy("place")
    length = F.length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(
        each.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kinds = F.array(*[F.lit(k) for k, *_ in PATTERNS])
    strict = F.array(*[F.lit(s) for _, s, *_ in PATTERNS])
    rows = rows.withColumn("start", F.col("end") - length).withColumn("kind", F.get(kinds, F.col("pattern")))
    digits = F.regexp_replace("match", "[^0-9]", "")
    valid = (F.when(F.col("kind") == "ip", F.col("match").rlike(OCTETS))
             .when(F.col("kind") == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
             .when(F.col("kind") == "phone", F.length(digits).between(8, 15))
             .otherwise(F.lit(True)))
    return rows.withColumn("base", F.get(strict, F.col("pattern")) & valid).withColumn("valid", valid).drop("gap", "place")


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def votes(rows: DataFrame) -> DataFrame:
    """Votes (1, -1, 0 for none) of the labelers and shape flags of every candidate."""
    kind, match = F.col("kind"), F.col("match")
    before = F.lower("before")
    context = F.lit(False)
    for k, names in CONTEXT.items():
        context = F.when(kind == k, before.rlike(r"\b(?:" + "|".join(names) + r")[a-z]*\W*$")
                         | before.rlike("|".join(names))).otherwise(context)
    domain = F.lower(F.regexp_extract("match", r"([A-Za-z0-9-]+)\s*$", 1))
    issuer = match.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)")
    reserved = match.rlike(r"^0*(?:0|10|127|255|22[4-9]|23[0-9])\.")
    mixed = match.rlike("[A-Za-z]") & match.rlike("[0-9]")
    gazetteer = (F.when(kind == "email", _sign(domain.isin(*DOMAINS), F.lit(False)))
                 .when(kind == "card", _sign(issuer, ~issuer))
                 .when(kind == "ip", _sign(~reserved, reserved))
                 .when(kind == "phone", _sign(match.rlike(r"^\+?[1-9(]"), match.rlike("^0{4}")))
                 .otherwise(_sign(mixed, ~mixed)))
    inside = before.rlike("[a-z0-9_]$") | F.col("after").rlike("^[A-Za-z0-9_]")
    return (rows.withColumn("regex", _sign(F.col("valid"), ~F.col("valid")))
            .withColumn("gazetteer", gazetteer)
            .withColumn("context", _sign(context, F.lit(False)))
            .withColumn("counter", _sign(F.lit(False), before.rlike("|".join(AGAINST))))
            .withColumn("border", _sign(~inside, inside))
            .withColumn("long", (F.length("match") >= 32).cast("int"))
            .withColumn("mixed", mixed.cast("int"))
            .withColumn("hex", match.rlike("^[0-9a-f]+$").cast("int"))
            .withColumn("assigned", before.rlike(r"[=:]\s*[\"']?$").cast("int")))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60):
    """Expectation-maximisation over counted vote patterns: ``(kind, votes, count)``.

    Returns the posterior of each pattern, the share of true spans per kind and, per labeler,
    the chances of a yes and of a no for true and for false spans. A weak prior keeps the
    meaning of "true" and stands where there are no candidates."""
    kinds = np.array([KINDS.index(k) for k, _, _ in patterns], int)
    cast = np.array([v for _, v, _ in patterns], int).reshape(len(patterns), len(LABELERS))
    count = np.array([n for _, _, n in patterns], float)
    # chance of votes -1, 0, 1 for false and true spans
    prior = np.array([[0.45, 0.35, 0.2], [0.1, 0.3, 0.6]]) * 20
    chance = np.tile(prior / prior.sum(1, keepdims=True), (len(LABELERS), 1, 1))
    share = np.full(len(KINDS), 0.5)
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        if not len(patterns):
            break
        log = np.stack([np.log(1 - share[kinds]), np.log(share[kinds])], 1)
        for j in range(len(LABELERS)):
            log += np.log(chance[j][:, cast[:, j] + 1]).T
        log -= log.max(1, keepdims=True)
        post = np.exp(log[:, 1]) / np.exp(log).sum(1)
        for k in range(len(KINDS)):
            own = kinds == k
            share[k] = (post[own] @ count[own] + 2) / (count[own].sum() + 4)
        scale = max(1.0, count.sum() / 100)  # the prior weighs a fifth of all votes at most
        for j in range(len(LABELERS)):
            for v in range(3):
                own = cast[:, j] == v - 1
                chance[j, 0, v] = prior[0, v] * scale + ((1 - post) * count)[own].sum()
                chance[j, 1, v] = prior[1, v] * scale + (post * count)[own].sum()
            chance[j] /= chance[j].sum(1, keepdims=True)
    return post, share, chance


def _features(kind: str, cast: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS), *map(float, cast), *map(float, shape)]


def train(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], int]]) -> np.ndarray:
    """Weights of the span classifier from counted ``(kind, votes, shapes, count)``."""
    merged: dict[tuple, int] = {}
    for kind, cast, _, n in rows:
        merged[kind, cast] = merged.get((kind, cast), 0) + n
    keys = sorted(merged)
    post, _, _ = reliabilities([(k, v, merged[k, v]) for k, v in keys])
    of = dict(zip(keys, post, strict=True))
    start = np.array(_features("", (0,) * len(LABELERS), (0,) * len(SHAPES)))
    weights = np.zeros(len(start))
    weights[1 + len(KINDS):][: len(LABELERS)] = 1.0
    weights[0] = -0.5
    if not rows:
        return weights
    x = np.array([_features(k, v, s) for k, v, s, _ in rows])
    y = np.array([of[k, v] for k, v, _, _ in rows])
    n = np.array([c for *_, c in rows], float)
    n *= min(1.0, 1e4 / n.sum())
    centre = weights.copy()
    for _ in range(40):  # Newton steps with a pull to the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (p - y)) + (weights - centre)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def _score(weights: np.ndarray) -> Column:
    w = [round(float(v), 9) for v in weights]
    total = F.lit(w[0])
    for k, v in zip(KINDS, w[1:], strict=False):
        total = total + F.when(F.col("kind") == k, F.lit(v)).otherwise(F.lit(0.0))
    for name, v in zip((*LABELERS, *SHAPES), w[1 + len(KINDS):], strict=True):
        total = total + F.col(name) * F.lit(v)
    return total


def decided(df: DataFrame, key: str, text: str) -> DataFrame:
    """Candidates of all rows with ``base`` and ``accepted``. A proposed span that the
    classifier takes is dropped where it overlaps a base span of its kind."""
    rows = written(votes(candidates(df, key, text)), "spans")
    counts = rows.filter(F.col("kind").isNotNull()).groupBy("kind", *LABELERS, *SHAPES).count().collect()
    n = len(LABELERS)
    weights = train([(r[0], tuple(r[1:1 + n]), tuple(r[1 + n:-1]), r[-1]) for r in sorted(counts)])
    each = Window.partitionBy("_row", "kind").orderBy("start", "end")
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(each.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("_row", "kind").orderBy(F.col("start").desc(), F.col("end").desc())
    starts = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.coalesce(ends, F.lit(-1)) <= F.col("start")) & (F.coalesce(starts, F.col("end")) >= F.col("end"))
    strict = F.array(*[F.lit(s) for _, s, *_ in PATTERNS])
    proposed = ~F.get(strict, F.col("pattern")) & F.col("valid") & (_score(weights) > math.log(0.5 / 0.5))
    return rows.repartition("_row").withColumn("accepted", F.col("base") | (proposed & apart))


def _joined(condition: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = F.sort_array(F.collect_list(F.when(condition, F.struct(
        rank.alias("r"), F.col("start"), F.col("end"), F.col("kind")))))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, base counts, digest of the base spans, all spans as text."""
    rows = decided(df, key, text)
    base = F.coalesce(F.col("base"), F.lit(False))
    counts = [F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]]
    added = F.count(F.when(F.col("accepted") & ~base, 1)).alias("n_added")
    out = rows.groupBy("_row", "_key").agg(
        *counts, _joined(base).alias("_base"), _joined(F.coalesce("accepted", F.lit(False))).alias("spans"), added)
    return out.select(F.col("_key").alias(key), *[f"n_{k}" for k in KINDS[:4]],
                      F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with every accepted span of ``text`` replaced by its kind in brackets."""
    rows = decided(df, key, text).filter(F.col("accepted"))
    spans = rows.groupBy("_row", "_key", "_hash").agg(F.sort_array(F.collect_list(
        F.struct("start", (-F.col("end")).alias("minus"), "kind"))).alias("_spans"))
    spans = spans.groupBy("_key", "_hash").agg(F.first("_spans").alias("_spans"))
    hashed = df.withColumn("_hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn("_key", F.col(key))
    joined = hashed.alias("d").join(
        spans.alias("s"), F.col("d._key").eqNullSafe(F.col("s._key")) & (F.col("d._hash") == F.col("s._hash")), "left")
    built = F.expr(f"""aggregate(_spans, struct(cast('' AS string) AS t, cast(0 AS bigint) AS at),
        (a, s) -> struct(
            CASE WHEN -s.minus <= a.at THEN a.t
                 ELSE concat(a.t, substring(d.{text}, int(a.at + 1), int(greatest(s.start - a.at, 0))),
                             '[', upper(s.kind), ']') END AS t,
            greatest(a.at, -s.minus) AS at),
        a -> concat(a.t, substring(d.{text}, int(a.at + 1))))""")
    new = F.when(F.col("_spans").isNull(), F.col(f"d.{text}")).otherwise(built)
    return joined.select(*[new.alias(text) if c == text else F.col(f"d.{c}") for c in df.columns])
