"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a span
classifier is trained on the result. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.spans import joined, matches, without_overlaps
from pagesieve.session import cut_lineage

# An address begins where its run of letters begins, or where the match before it ended: no run is read more than twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own kinds: local phone numbers, social-security-like numbers, bank accounts, written-out addresses (of any number of
#: domain labels; 64 and 63 characters are the most that a mailbox name and a label can have).
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
SPELT_EMAIL = (
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{2,63}"
    r"(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{2,63})*\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z]{2,24}"
)
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "national_id", "account", "spelt_email")

#: Gazetteers. Plain values: mail providers and top-level domains, card issuers' first digits, dialling codes.
MAIL_NAMES = "(?i)gmail|yahoo|hotmail|outlook|proton|icloud|gmx|aol|mail"
TOP_LEVEL = r"(?i)(?:\.|dot\W{0,2})(?:com|org|net|edu|gov|io|de|fr|es|it|uk|nl|eu|co|info|me)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
DIALLING = r"^\+(?:1|33|34|39|44|49|7|81|86|91)"
COUNTRIES = r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT|SE)"
#: Words shortly before a span that speak for or against personal data, of any kind.
CONTEXT_CHARACTERS = 40
FOR_WORDS = r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|reach|write to|ip|address|host|card|visa|account|iban|ssn|social security)\b"
AGAINST_WORDS = r"(?i)\b(?:version|release|build|isbn|order|invoice|ticket|serial|part|model|section|figure|port|example|sample)\b"

LABELERS = ("shape", "gazetteer", "checksum", "context", "border")
FEATURES = ("kind", "length", "digits", "before", "after")
ROUNDS = 8
#: An added span is kept, and the classifier says yes, from this probability on.
ACCEPTED = 0.5
#: Starting reliabilities: a vote for is right in 7 cases of 10, and so many truths a labeler abstains on.
START_PRIOR, START_RIGHT, START_ABSTAINS = 0.5, 0.7, 0.3
SMOOTHING = 1.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, 9 taken off beyond 9; the sum ends in 0."""
    reversed_digits = F.split(F.reverse(digits(value)), "")
    doubled = F.transform(reversed_digits, lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def bytes_in_range(value: Column) -> Column:
    return F.forall(F.split(value, "\\."), lambda part: part.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)$"))


def card_like(value: Column) -> Column:
    # Two conditions in one CASE, so that only numbers of the right length are summed up.
    return F.when(F.length(digits(value)).between(16, 19), passes_luhn(value)).otherwise(False)


def find_spans(text: str) -> list[Column]:
    """All candidate spans of one text, a column for each kind, base kinds first."""
    return [
        matches(text, EMAIL, "email", 0), matches(text, IP, "ip", 1, keep=bytes_in_range),
        matches(text, CARD, "card", 2, keep=card_like), matches(text, PHONE, "phone", 3, keep=lambda m: F.length(digits(m)).between(8, 15)),
        matches(text, LOCAL_PHONE, "local_phone", 4), matches(text, NATIONAL_ID, "national_id", 5),
        matches(text, ACCOUNT, "account", 6), matches(text, SPELT_EMAIL, "spelt_email", 7),
    ]


def border_class(character: Column) -> Column:
    return (
        F.when(character == "", "edge").when(character.rlike(r"\s"), "space").when(character.rlike("[.,;:!?)\\]\"']"), "stop")
        .when(character.rlike("[A-Za-z0-9]"), "word").otherwise("other")
    )


def find_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: candidate spans with the ``lead`` before them and the ``next`` character."""
    kinds = [*BASE_KINDS, *ADDED_KINDS]
    found = docs.select("*", *[c.alias(f"_{k}") for k, c in zip(kinds, find_spans(text))])
    base, added = (F.concat(*[f"_{k}" for k in names]) for names in (BASE_KINDS, ADDED_KINDS))

    def placed(span: Column) -> Column:
        first = F.greatest(span["start"] - CONTEXT_CHARACTERS, F.lit(0))
        return span.withField("lead", F.substring(text, first + 1, span["start"] - first)).withField("next", F.substring(text, span["end"] + 1, F.lit(1)))

    found = found.withColumns({"_base": base, "_added": added}).drop(*[f"_{k}" for k in kinds])
    return found.withColumns({"_base": F.transform("_base", placed), "_added": F.transform(without_overlaps("_added", F.col("_base")), placed)})


def votes(span: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 for, -1 against, 0 nothing."""
    kind, value = span["kind"], span["value"]
    before, after = border_class(F.right(span["lead"], F.lit(1))), border_class(span["next"])

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    mail, number = kind.isin("email", "spelt_email"), digits(value)
    return {
        "shape": F.when(mail, vote(value.rlike(r"^[A-Za-z0-9]") & ~value.rlike(r"\.\."), F.lit(True)))
        .when(kind == "ip", vote(~value.rlike(r"^0|\.0[0-9]"), F.lit(True)))
        .when(kind == "card", vote(value.rlike(r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.lit(True)))
        .when(kind == "phone", vote(F.length(number).between(10, 13), value.rlike(r"[.-]{2}| {2}"))).otherwise(1),
        "gazetteer": F.when(mail, vote(value.rlike(MAIL_NAMES) | value.rlike(TOP_LEVEL), F.lit(True)))
        .when(kind == "ip", vote(~F.substring_index(value, ".", 1).isin("0", "10", "127", "255"), F.lit(True)))
        .when(kind == "card", vote(number.rlike(ISSUERS), F.lit(True)))
        .when(kind == "phone", vote(value.rlike(DIALLING), F.lit(False)))
        .when(kind == "account", vote(value.rlike(COUNTRIES), F.lit(True))).otherwise(0),
        "checksum": F.when(kind == "card", 1).when(kind == "national_id", vote(~value.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True)))
        .when(kind == "local_phone", vote(number.rlike("^[2-9]"), F.lit(True))).otherwise(0),
        "context": vote(span["lead"].rlike(FOR_WORDS), span["lead"].rlike(AGAINST_WORDS)),
        "border": vote(before.isin("edge", "space", "stop") & after.isin("edge", "space", "stop"), (before == "word") | (after == "word")),
    }


def features(span: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate; each has a handful of values."""
    length = F.length(span["value"])
    return {
        "kind": span["kind"], "length": F.least(F.floor(length / 4), F.lit(8)).cast("string"),
        "digits": F.floor(4 * F.length(digits(span["value"])) / length).cast("string"),
        "before": border_class(F.right(span["lead"], F.lit(1))), "after": border_class(span["next"]),
    }


@dataclass(frozen=True)
class Reliabilities:
    """The share of true spans, and for each labeler how often it votes for, abstains and votes against, given the truth."""

    prior: float
    given: dict[str, dict[bool, tuple[float, float, float]]]  # votes -1, 0, 1

    def posterior(self) -> Column:
        """Probability of being personal data, given the votes."""

        # A folded array is no part of the generated code, so that all rounds share it.
        prior = F.array(F.log(F.lit(self.prior / (1 - self.prior))))
        total = F.get(prior, F.lit(0))
        for name in LABELERS:
            odds = F.array(*[F.log(F.lit(true / false)) for true, false in zip(self.given[name][True], self.given[name][False])])
            total = total + F.get(odds, F.col(name) + 1)
        return 1 / (1 + F.exp(-total))


def starting_point() -> Reliabilities:
    right, rest = START_RIGHT * (1 - START_ABSTAINS), (1 - START_RIGHT) * (1 - START_ABSTAINS)
    return Reliabilities(START_PRIOR, {n: {True: (rest, START_ABSTAINS, right), False: (right, START_ABSTAINS, rest)} for n in LABELERS})


def estimate_reliabilities(cells: DataFrame) -> Reliabilities:
    """Expectation-maximisation over the table of vote patterns (columns of the labelers, and ``n``, how many spans vote so).

    The table has at most 3 ** 5 rows, whatever the corpus; each round is one aggregate over it.
    """
    now = starting_point()
    for _ in range(ROUNDS):
        p, judged = F.col("p"), cells.withColumn("p", now.posterior())
        sums = [F.sum(F.col("n") * p).alias("true"), F.sum(F.col("n") * (1 - p)).alias("false")]
        for name in LABELERS:
            for vote in (-1, 0, 1):
                here = F.when(F.col(name) == vote, F.col("n")).otherwise(0)
                sums += [F.sum(here * p).alias(f"{name}_{vote}_true"), F.sum(here * (1 - p)).alias(f"{name}_{vote}_false")]
        row = judged.agg(*sums).first()
        if row["true"] is None:
            return now

        def shares(name: str, side: str) -> tuple[float, float, float]:
            return tuple((row[f"{name}_{v}_{side}"] + SMOOTHING) / (row[side] + 3 * SMOOTHING) for v in (-1, 0, 1))

        prior = (row["true"] + SMOOTHING) / (row["true"] + row["false"] + 2 * SMOOTHING)
        now = Reliabilities(prior, {n: {True: shares(n, "true"), False: shares(n, "false")} for n in LABELERS})
    return now


@dataclass(frozen=True)
class SpanClassifier:
    """A naive Bayes classifier over the features of a span: prior odds, and odds for each value of each feature."""

    prior: float
    odds: dict[str, list[tuple[str, float]]]

    def probability(self, span: Column) -> Column:
        total = F.log(F.lit(self.prior / (1 - self.prior)))
        for name, feature in features(span).items():
            if self.odds[name]:
                odds = F.create_map(*[x for value, odds in self.odds[name] for x in (F.lit(value), F.log(F.lit(odds)))])  # features are never null
                total = total + F.coalesce(odds[feature], F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def train(candidates: DataFrame) -> SpanClassifier:
    """From the candidates of :func:`find_candidates`: votes, reliabilities, and a classifier with the posteriors as soft labels.

    Only counts of equal votes and features are grouped, and only a few dozen weights come back.
    """
    one = candidates.select(F.explode(F.concat("_base", "_added")).alias("s"))
    one = one.select(*[c.alias(n) for n, c in votes(F.col("s")).items()], *[c.alias(n) for n, c in features(F.col("s")).items()])
    cells = cut_lineage(one.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")))
    reliabilities = estimate_reliabilities(cells.groupBy(*LABELERS).agg(F.sum("n").alias("n")))
    judged = cells.withColumn("p", reliabilities.posterior())
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    sums = judged.select("n", "p", F.explode(pairs).alias("f")).groupBy("f.feature", "f.value").agg(
        F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false")
    )
    rows = sums.orderBy("feature", "value").collect()
    odds: dict[str, list[tuple[str, float]]] = {f: [] for f in FEATURES}
    for f in FEATURES:
        own = [r for r in rows if r["feature"] == f]
        true, false = sum(r["true"] for r in own), sum(r["false"] for r in own)
        odds[f] = [(r["value"], ((r["true"] + SMOOTHING) / (true + SMOOTHING)) / ((r["false"] + SMOOTHING) / (false + SMOOTHING))) for r in own]
    return SpanClassifier(reliabilities.prior, odds)


def accepted(classifier: SpanClassifier) -> Column:
    """Base spans by kind, then start; then the added spans that the classifier takes for personal data."""
    added = F.filter("_added", lambda s: classifier.probability(s) >= ACCEPTED)
    return F.transform(F.concat("_base", added), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "kind", "end", "value")]))


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs`` (needs ``doc_id`` and ``text``; other columns are ignored).

    ``spans`` holds start, rank, kind, end (code points, end exclusive) and value, by kind as listed, then by start. Base spans
    always stay. Spans of the added kinds that share no character with a base span stay if the classifier says 0.5 or more.

    Texts are read once: candidates are found where the text lies, with the few characters around them that the labelers need.

    Null and empty texts have no spans. Repeated rows and doc_ids are each returned. An empty table gives no rows; without
    candidates the classifier keeps the starting prior.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    found = cut_lineage(find_candidates(narrow, "_text").drop("_text"))
    return found.select("doc_id", accepted(train(found)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; all rows and columns stay.

    Overlapping spans become one tag, that of the span that starts first. Null texts stay null. Needs only ``text``; a row is carried as
    one value, so other columns may have any name.
    """
    narrow = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    classifier = train(cut_lineage(find_candidates(narrow, "_text").drop("_text")))
    spans = F.array_sort(accepted(classifier))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring("_text", state["at"] + 1, span["start"] - state["at"])
        tagged = F.concat(state["parts"], F.array(gap, F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))))
        new = span["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(new, tagged).otherwise(state["parts"]).alias("parts"))

    whole = F.array_join(F.concat("_done.parts", F.array(F.substring("_text", F.col("_done.at") + 1, F.length("_text")))), "")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    found = find_candidates(rows, "_text").withColumn("_spans", spans).withColumn("_done", F.aggregate("_spans", start, step))
    text = F.when(F.size("_spans") > 0, whole).otherwise(F.col("_text")).alias("text")
    return found.select(*[text if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def pii_digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from the spans of :func:`find_pii`."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] >= len(BASE_KINDS))).cast("long").alias("n_added"),
    )
