"""Personal data: patterns, and spans that several weak labelers agree on.

In DataFrame operations only.  The base kinds are patterns with a check (e-mail,
IP address, card number by Luhn, phone number).  The method adds spans: wider
candidates (long tokens, long numbers) get a vote each from a regex, a gazetteer
and context labelers; expectation maximisation over the counts of vote patterns
estimates how reliable each labeler is in each class, and the posteriors train a
logistic classifier over votes and shape that decides on each candidate.  Only
counts of patterns, of which there are a fixed number at most, come to the
driver; they are taken over all rows.

Spans are in code points, the end exclusive.  A candidate that overlaps a base
span is no candidate.  Null and empty texts have no span.  Repeated rows and
extra columns are kept.  Patterns are linear in the text: what may repeat is
possessive, and a match starts only where a run of its characters starts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]
_LOCAL = "[A-Za-z0-9._%+-]"
#: A local part starts at the start of its run, or where the match before it ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![A-Za-z0-9_])[0-9](?:[\x20-]?[0-9])++(?![A-Za-z0-9_])"
TOKEN = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+"
GAZETTEER = (
    "account api auth bearer card credential iban id key login passwd password private pwd secret "
    "ssn token user"
).split()
#: So many code points before a candidate are its context.
CONTEXT = 24
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, pattern: str, kind: int, valid, present: Column) -> Column:
    """Spans of the leftmost matches that are ``valid``; only texts that are ``present`` are searched.

    What lies between two matches and the matches themselves are as long as the text.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
            pair["value"].alias("value"),
        )
        known = pair["value"].isNotNull()  # the last gap has no match after it
        spans = F.when(known & valid(pair["value"]), F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), F.coalesce(spans, state["spans"]).alias("spans"))

    pairs = F.zip_with(
        gaps, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value"))
    )
    spans = F.aggregate(pairs, start, step, lambda state: state["spans"])
    return F.when(present, spans).otherwise(F.array().cast(_SPAN))


def _always(value):
    return F.lit(True)


def _ip(value):
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def _plain(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(state, digit):
        d = digit.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct(
            (state["total"] + F.when(state["odd"], twice).otherwise(d)).alias("total"),
            (~state["odd"]).alias("odd"),
        )

    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("odd"))
    return F.aggregate(
        F.reverse(F.split(digits, "")), start, add, lambda state: state["total"] % 10 == 0
    )


def _card(value):
    digits = _plain(value)
    size = F.length(digits).between(12, 19)
    return size & F.when(size, luhn(digits)).otherwise(F.lit(False))


def _number(value):
    return F.length(_plain(value)).between(9, 19)


def base_spans(text: Column) -> Column:
    """The spans of the base kinds by start, then kind."""
    return F.sort_array(
        F.concat(
            matches(text, EMAIL, 0, _always, F.contains(text, F.lit("@"))),
            matches(text, IP, 1, _ip, text.rlike(r"[0-9]\.[0-9]")),
            matches(text, DIGITS, 2, _card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
            matches(
                text, PHONE, 3, lambda v: F.length(_plain(v)).between(9, 15),
                F.contains(text, F.lit("+")),
            ),
        )
    )


def _free(spans: Column, base: Column) -> Column:
    return F.filter(
        spans,
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )


def candidates(text: Column, base: Column) -> Column:
    """Long tokens with a digit and long numbers that overlap no base span."""
    token = matches(
        text, TOKEN, 4, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z_]"), text.rlike(r"\w{16}")
    )
    number = matches(text, NUMBER, 5, _number, text.rlike(r"[0-9](?:[\x20-]?[0-9]){8}"))
    return _free(F.concat(token, number), base)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(text: Column, span: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 for none."""
    value, begin = span["value"], span["start"]
    first = F.greatest(begin - CONTEXT, F.lit(0))
    before = F.lower(F.substring(text, first + 1, begin - first))
    listed = before.rlike(rf"(?:^|[^a-z])(?:{'|'.join(GAZETTEER)})(?:[^a-z]|$)")
    return [
        # regex: shapes of known keys and numbers
        _vote(
            value.rlike(r"^(?:[0-9a-f]{32,64}|[A-Z0-9]{20}|[A-Za-z]{2,4}_[A-Za-z0-9]{20,})$"),
            value.rlike(r"^[A-Za-z_]+[0-9]?$") | (F.length(value) < 12),
        ),
        # gazetteer: a listed word before it
        _vote(listed, ~before.rlike("[a-z]")),
        # context: assigned or quoted
        _vote(before.rlike(r"""[=:]\s*["']?$|["'(]$"""), before.rlike(r"[\p{L},.]\s+$")),
        # shape: letters and digits mixed throughout
        _vote(
            value.rlike(r"[0-9][A-Za-z]+[0-9]+[A-Za-z]"), value.rlike(r"^[0-9\x20-]*$")
        ),
    ]


N_LABELERS = 4
#: Upper bounds of the length classes of the classifier.
_LENGTHS = (12, 20, 32, 48)


def _length_class(span: Column) -> Column:
    size = span["end"] - span["start"]
    return sum(((size > n).cast("int") for n in _LENGTHS), F.lit(0))


@dataclass(frozen=True)
class Classifier:
    """Weights of votes (labeler, vote + 1), length classes and kinds, and of the constant."""

    votes: tuple[tuple[float, float, float], ...]
    lengths: tuple[float, ...]
    kinds: tuple[float, ...]
    constant: float

    def keeps(self, text: Column, span: Column) -> Column:
        total = F.lit(self.constant)
        for vote, weights in zip(votes(text, span), self.votes):
            total += F.element_at(F.array(*map(F.lit, weights)), vote + 2)
        total += F.element_at(F.array(*map(F.lit, self.lengths)), _length_class(span) + 1)
        total += F.when(span["kind"] == 4, self.kinds[0]).otherwise(self.kinds[1])
        return total > 0


def expectation_maximisation(
    patterns: np.ndarray, counts: np.ndarray, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, reliabilities [labeler, class, vote + 1])."""
    posterior = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    for _ in range(rounds):
        share = np.stack([1 - posterior, posterior]) * counts
        prior = (share.sum(axis=1) + 1) / (counts.sum() + 2)
        rates = np.empty((patterns.shape[1], 2, 3))
        for vote in (-1, 0, 1):
            rates[:, :, vote + 1] = ((patterns == vote).T[:, None, :] * share).sum(axis=2)
        rates = (rates + 0.5) / (rates + 0.5).sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(
            np.log(rates[j][:, patterns[:, j] + 1]) for j in range(patterns.shape[1])
        )
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, rates


def fit(df: DataFrame, text: str = "text") -> Classifier:
    """The classifier from the candidates of all rows."""
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9]"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.select("text", F.explode(candidates(F.col("text"), F.col("base"))).alias("s"))
    named = {f"v{i}": v for i, v in enumerate(votes(F.col("text"), F.col("s")))}
    features = rows.select(
        *(v.alias(k) for k, v in named.items()),
        _length_class(F.col("s")).alias("length"),
        F.col("s.kind").alias("kind"),
    )
    # 3 ** 4 votes, 5 lengths and 2 kinds: 810 rows at most
    counted = features.groupBy(*features.columns).count().collect()
    if not counted:
        return Classifier(((0.0,) * 3,) * N_LABELERS, (0.0,) * 5, (0.0, 0.0), -1.0)
    counted = sorted(tuple(r) for r in counted)
    table = np.array(counted, float)
    patterns, counts = table[:, :N_LABELERS].astype(int), table[:, -1]
    posterior, _ = expectation_maximisation(patterns, counts)
    columns = [(patterns[:, j] == v) for j in range(N_LABELERS) for v in (-1, 0, 1)]
    columns += [(table[:, N_LABELERS] == n) for n in range(5)]
    columns += [(table[:, N_LABELERS + 1] == k) for k in (4, 5)]
    x = np.stack([*columns, np.ones(len(table))], axis=1).astype(float)
    w, share = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(40):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - posterior)) + 1e-3 * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hessian, gradient)
    w = np.round(w, 9)
    return Classifier(
        tuple(tuple(map(float, w[3 * j : 3 * j + 3])) for j in range(N_LABELERS)),
        tuple(map(float, w[12:17])),
        tuple(map(float, w[17:19])),
        float(w[19]),
    )


def find(
    df: DataFrame, classifier: Classifier, text: str = "text", base: str = "base", spans: str = "spans"
) -> DataFrame:
    """``df`` with arrays of its ``base`` spans and of all ``spans``, by start, then kind."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    located = df.withColumn(base, base_spans(whole))
    more = F.filter(
        candidates(whole, F.col(base)), lambda s: classifier.keeps(whole, s)
    )
    return located.withColumn(spans, F.sort_array(F.concat(F.col(base), more)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<kind>``; of overlapping ones, the first's name once."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("<"), names[s["kind"]], F.lit(">"))
        parts = F.when(
            s["start"] >= state["at"], F.concat(state["parts"], F.array(F.concat(gap, mark)))
        ).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(state):
        rest = F.substring(text, state["at"] + 1, F.length(text))
        return F.array_join(F.concat(state["parts"], F.array(rest)), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)
