"""Operator 10: personal data by weak-supervision aggregation.

Four kinds have exact definitions (e-mail addresses, IP numbers, payment cards,
phone numbers); their spans are always reported. Beyond them, other strings
that hold a digit are candidates for credentials ("secret"). No labels exist
for these, so several weak labelers vote on each candidate:

* regex labelers on its own shape,
* gazetteer labelers on the words before it (credential words; words that
  introduce harmless numbers),
* context labelers on how it is attached (assignment, quotes).

Votes are private (1), harmless (-1) or none (0). Expectation-maximisation over
the table of vote patterns (at most 3 to the number of labelers rows, with
counts over all documents) estimates how reliable each labeler is. The
posteriors then train the final span classifier, a naive Bayes model over
features of the span and its surroundings, which decides about every candidate
that at least one labeler supports.

Everything that runs over documents is built-in DataFrame functions; the
driver handles the bounded table of vote patterns and features only.

Positions are code points, ends exclusive. Java's regular expressions would
recurse on long runs or rescan them from every character, so the patterns
below are written with possessive repetition and only start where a match can
start; they find the same spans (the tests compare with the plain patterns).

Defined results: a null text is empty and has no spans; repeated rows each get
their result; an empty table gives no rows (and a model without candidates adds
no spans); other columns are not read by ``find``, and ``redact`` passes them on.
Column names of the form ``__pii_*`` are reserved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import keep

# The definitions of the base kinds, in reporting order.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # fewer than 13 digits never pass
PHONE = r"\+[0-9](?=(?:[ ().-]*+[0-9]){8})[ ().0-9-]+[0-9]"  # fewer than 9 digits never pass
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
CONTEXT = 28  # characters before a candidate that the labelers see

# Gazetteers.
CREDENTIAL_WORDS = (
    "token", "secret", "password", "passwd", "pwd", "api key", "api_key", "apikey", "access key", "access_key",
    "private key", "private_key", "auth", "bearer", "credential", "passport", "ssn", "iban", "pin",
)
HARMLESS_WORDS = (
    "version", "page", "figure", "chapter", "section", "table", "volume", "isbn", "issn", "doi", "item", "line",
    "year", "copyright", "http", "www", "commit", "build", "release",
)

LABELERS = ("shape", "plain_number", "variety", "credential_word", "harmless_word", "assignment")


def _word_pattern(words: tuple[str, ...]) -> str:
    return r"(?i)(?<![a-z])(?:" + "|".join(w.replace(" ", r"\s") for w in words) + r")(?![a-z])"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _located(text: Column, pattern: str) -> Column:
    """Matches with their places: the parts between them and the matches add up to the text."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def along(found: Column, parts: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            part, value = F.get(parts, i), F.get(found, i)
            start = state["at"] + F.length(part)
            end = start + F.length(value)
            before = F.right(part, F.lit(CONTEXT))
            span = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), before.alias("before"))
            return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

        start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["spans"])

    def located(found: Column) -> Column:
        return F.when(
            F.size(found) > 0, _let(F.split(text, pattern, -1), lambda parts: along(found, parts))
        ).otherwise(empty)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small_part(part: Column) -> Column:
    number = F.regexp_replace(part, "^0+", "")
    return (F.length(number) <= 3) & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 255)


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda s: _passes(kind, s["value"])


def _numbered(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is_kind(kind: int):
    return lambda s: s["kind"] == kind


def _votes(span: Column) -> list[Column]:
    value, before = span["value"], span["before"]
    letters, digits = value.rlike("[A-Za-z]"), F.length(_digits(value))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    vote = lambda yes, no: F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))
    never = F.lit(False)
    return [
        vote(letters & (digits >= 4) & (F.length(value) >= 20), F.length(value) < 12),
        vote(never, ~letters),
        vote(letters & (distinct >= 10), distinct <= 5),
        vote(before.rlike(_word_pattern(CREDENTIAL_WORDS)), never),
        vote(never, before.rlike(_word_pattern(HARMLESS_WORDS))),
        vote(before.rlike(r"[=:]\s?[\"'`]?$"), before.rlike(r"[A-Za-z0-9]\s$")),
    ]


def _features(span: Column) -> list[Column]:
    value, before = span["value"], span["before"]
    size = F.length(value)
    return [
        F.when(size < 12, "short").when(size < 20, "medium").when(size < 48, "long").otherwise("huge"),
        F.when(value.rlike("^[0-9]+$"), "digits")
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(value.rlike("[a-z]") & value.rlike("[A-Z]"), "mixed")
        .otherwise("plain"),
        F.when(before.rlike(r"[\"'`]$"), "quoted").when(before.rlike(r"[=:]\s?$"), "assigned").otherwise("free"),
        F.when(before.rlike(_word_pattern(CREDENTIAL_WORDS)), "credential")
        .when(before.rlike(_word_pattern(HARMLESS_WORDS)), "harmless")
        .otherwise("other"),
    ]


FEATURES = 4


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__pii_base`` (kind number, start, end) and ``__pii_candidates`` (with votes and features)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("__pii_text", text)
    patterns = {**BASE, "candidate": CANDIDATE}
    rows = rows.withColumns({f"__pii_{k}": _located(F.col("__pii_text"), p) for k, p in patterns.items()})
    base = F.concat(*[
        F.transform(
            F.filter(f"__pii_{kind}", _passing(kind)),
            _numbered(i),
        )
        for i, kind in enumerate(BASE)
    ])
    rows = rows.withColumn("__pii_base", base)
    free = F.filter(
        "__pii_candidate",
        lambda c: ~F.exists("__pii_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    described = F.transform(
        free,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"),
            F.array(*_votes(c)).alias("votes"), F.array(*_features(c)).alias("features"),
        ),
    )
    rows = rows.withColumn("__pii_candidates", described)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__pii_text", "__pii_base", "__pii_candidates")


@dataclass(frozen=True)
class SpanModel:
    """Log odds of a span being private: ``bias`` plus a weight per feature value."""

    bias: float
    weights: tuple[dict[str, float], ...]
    reliabilities: dict[str, tuple[float, float]]  # labeler -> P(vote private | private), P(vote private | harmless)
    threshold: float = 0.9

    def private(self, candidate: Column) -> Column:
        odds = F.lit(self.bias)
        for i, weights in enumerate(self.weights):
            pairs = [F.lit(x) for item in weights.items() for x in item]
            if pairs:
                odds = odds + F.coalesce(F.create_map(*pairs)[candidate["features"][i]], F.lit(0.0))
        supported = F.exists(candidate["votes"], lambda v: v > 0)
        return supported & (odds >= math.log(self.threshold / (1 - self.threshold)))


def fit_em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """Posterior of each vote pattern and the labelers' vote distributions, by expectation-maximisation.

    Starts from the balance of the votes. Pseudo-counts say that a labeler is
    right rather than wrong, which keeps the two classes from changing places.
    """
    posterior = [1 / (1 + math.exp(-2.0 * sum(votes))) for votes, _ in patterns]
    n = len(patterns[0][0]) if patterns else 0
    tables: list[dict] = []
    for _ in range(rounds):
        prior = [1.0, 1.0]
        tables = [{c: {v: 2.0 if v == (1 if c else -1) else 1.0 for v in (-1, 0, 1)} for c in (0, 1)} for _ in range(n)]
        for (votes, count), p in zip(patterns, posterior):
            for c, share in ((1, p), (0, 1 - p)):
                prior[c] += share * count
                for table, vote in zip(tables, votes):
                    table[c][vote] += share * count
        for table in tables:
            for c in (0, 1):
                total = sum(table[c].values())
                table[c] = {v: x / total for v, x in table[c].items()}
        posterior = []
        for votes, _ in patterns:
            odds = math.log(prior[1] / prior[0])
            odds += sum(math.log(t[1][v] / t[0][v]) for t, v in zip(tables, votes))
            posterior.append(1 / (1 + math.exp(-min(max(odds, -500), 500))))
    return posterior, tables


def fit(spans: DataFrame, threshold: float = 0.9) -> SpanModel:
    """Train on the candidates of all documents (``spans``: from ``with_spans``, best a written table)."""
    table = (
        spans.select(F.explode("__pii_candidates").alias("c"))
        .groupBy(F.col("c.votes").alias("votes"), F.col("c.features").alias("features"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most 3 ** 6 vote patterns times 4 * 4 * 3 * 3 feature values
    )
    by_votes: dict[tuple[int, ...], int] = {}
    for row in table:
        by_votes[tuple(row["votes"])] = by_votes.get(tuple(row["votes"]), 0) + row["n"]
    patterns = sorted(by_votes.items())
    posterior, tables = fit_em(patterns)
    of_votes = dict(zip((votes for votes, _ in patterns), posterior))
    totals = [1.0, 1.0]
    counts: list[dict[str, list[float]]] = [{} for _ in range(FEATURES)]
    for row in table:
        p = of_votes[tuple(row["votes"])]
        for c, share in ((1, p), (0, 1 - p)):
            totals[c] += share * row["n"]
            for i, value in enumerate(row["features"]):
                counts[i].setdefault(value, [1.0, 1.0])[c] += share * row["n"]
    weights = tuple(
        {v: math.log((x[1] / totals[1]) / (x[0] / totals[0])) for v, x in sorted(own.items())} for own in counts
    )
    reliabilities = {name: (t[1][1], t[0][1]) for name, t in zip(LABELERS, tables)}
    return SpanModel(math.log(totals[1] / totals[0]), weights, reliabilities, threshold)


def _all_spans(model: SpanModel) -> Column:
    secret = F.lit(len(BASE))
    added = F.transform(
        F.filter("__pii_candidates", model.private),
        lambda c: F.struct(secret.alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    return F.concat("__pii_base", added)


def _joined(spans: Column, names: list[str]) -> Column:
    kinds = F.array(*map(F.lit, names))
    written = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(written, ",")


def find(docs: DataFrame, threshold: float = 0.9, scratch: str | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans`` for every row of ``docs``.

    ``spans`` lists ``kind:start:end`` by kind, then start; ``base_sha256`` is
    the digest of that list for the four base kinds.
    """
    spans = with_spans(docs.select("doc_id", "text")).select("doc_id", "__pii_base", "__pii_candidates")
    spans = keep(spans, "spans", scratch)
    model = fit(spans, threshold)
    names = [*BASE, "secret"]
    rows = spans.withColumn("__pii_all", _all_spans(model))
    counts = [
        F.size(F.filter("__pii_all", _is_kind(i))).cast("long").alias(f"n_{name}")
        for i, name in enumerate(names)
    ]
    digest = F.sha2(_joined(F.col("__pii_base"), names).cast("binary"), 256)
    return rows.select(
        "doc_id", *counts, digest.alias("base_sha256"), _joined(F.col("__pii_all"), names).alias("spans")
    )


def redact(docs: DataFrame, threshold: float = 0.9, scratch: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    All columns stay; where the text changed and there is an ``n_chars``, it
    becomes the new length. Overlapping spans are replaced as one, under the
    kind of the one that starts first. Texts without spans stay as they are.
    """
    found = with_spans(docs)
    model = fit(keep(found.select("__pii_candidates"), "candidates", scratch), threshold)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in [*BASE, "secret"]])
    by_start = F.sort_array(F.transform(
        "__pii_all", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    ))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        between = F.substr(F.col("__pii_text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = F.concat(state["parts"], F.array(between, F.get(tags, s["kind"])))
        parts = F.when((s["start"] >= state["at"]), fresh).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(state: Column) -> Column:
        rest = F.substr(F.col("__pii_text"), state["at"] + 1, F.length("__pii_text"))
        return F.array_join(F.concat(state["parts"], F.array(rest)), "")

    rows = found.withColumn("__pii_all", _all_spans(model))
    changed = F.size("__pii_all") > 0
    rows = rows.withColumn("__pii_new", F.when(changed, F.aggregate(by_start, nothing, step, finish)))
    columns = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        if field.name == "text":
            column = F.coalesce("__pii_new", column)
        elif field.name == "n_chars":
            column = F.when(changed, F.length("__pii_new").cast(field.dataType)).otherwise(column)
        columns.append(column.alias(field.name))
    return rows.select(*columns)
