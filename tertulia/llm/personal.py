"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans. Three labelers vote on each (yes, no, or nothing): the form itself (checksums, ranges, counts
of digits), a gazetteer (top-level domains, issuer digits, country codes, given names), and the words before the span.
Votes are counted by pattern over all documents; expectation-maximisation on those counts estimates how reliable each
labeler is for each kind, and its posteriors train a logistic classifier of votes and shape, which judges every span.

Base spans (``email``, ``ip``, ``card`` and ``phone`` that pass their own test) are always reported. The method adds
what the classifier accepts: proposals of those kinds that fail their test but convince the other labelers, and the
kinds ``ssn``, ``iban`` and ``person``.

Positions are code points, ends exclusive. Null texts are empty and have no spans. Rows are never merged: repeated
rows repeat their result, and other columns are left out. Without any proposal the model is its prior.

Repeated groups in the patterns are possessive, which the characters after them allow, so long runs neither recurse
nor backtrack; a run that cannot be left of its own middle is entered at its start (or where the last match ended).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tertulia.llm.common import let
from tertulia.sources.staging import settle

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "person")
#: Least probability of an added span.
ACCEPTED = 0.9
YES, NO, NONE = 1, 0, 2
LABELERS = ("form", "gazetteer", "context")
SHAPES = 8
#: Code points before a span that the context labeler reads.
CONTEXT = 40
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![0-9A-Za-z])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?|Don|Doña)\b\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++){0,2}",
}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "mx", "ar", "br", "nl", "ch", "at", "be", "pl", "pt", "se", "jp", "cn", "in", "au")
CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "81", "82", "86", "90", "91", "351", "353", "358")
COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "RO", "SE")
NAMES = ("Ana", "Anna", "Carlos", "Carmen", "David", "Hans", "Isabel", "James", "Jean", "John", "José", "Juan", "Julia", "Laura", "Louis", "Luis", "Maria", "María", "Marie", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sophie", "Thomas")
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": "e-?mail|mail|correo|courriel|contact|write to",
    "ip": "ip|host|server|address|addr|dirección|adresse",
    "card": "card|credit|visa|mastercard|amex|tarjeta|karte|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|móvil|teléfono|telefon|handy|téléphone",
    "ssn": "ssn|social security|social",
    "iban": "iban|konto|account|cuenta|compte|bank",
    "person": "name|dear|contact|by|from|nombre|nom|von",
}
AGAINST = r"version|release|isbn|issn|doi|order|section|chapter|figure|fig|table|page|serial|part|sku|invoice|commit"


def _sums_before(lengths: Column) -> Column:
    """Sum of the numbers before each one. Blocks of 256 keep the work near linear."""
    size = 256

    def total(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda s, n: s + n)

    def with_blocks(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(own) - 1) / size).cast("int"), F.lit(0)))
        sums = F.transform(places, lambda b: total(F.slice(own, b * size + 1, size)))

        def with_bases(bases: Column) -> Column:
            return F.transform(
                own,
                lambda _, k: F.get(bases, F.floor(k / size).cast("int"))
                + total(F.slice(own, F.floor(k / size).cast("int") * size + 1, k % size)),
            )

        return let(let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, 1, b)))), with_bases)

    return let(lengths, with_blocks)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, text, before): every match, where it starts, and what lies between it and the one before."""

    def located(found: Column) -> Column:
        parts = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(parts, found, lambda p, m: F.struct(p.alias("before"), m.alias("text")))

        def placed(own: Column) -> Column:
            lengths = F.transform(own, lambda m: F.char_length(m["before"]) + F.char_length(m["text"]))
            return let(
                _sums_before(lengths),
                lambda base: F.transform(
                    own,
                    lambda m, k: F.struct(
                        (F.get(base, k) + F.char_length(m["before"])).alias("start"),
                        m["text"].alias("text"),
                        F.substring(m["before"], -CONTEXT, CONTEXT).alias("before"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, let(pairs, placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), located)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(
        F.sequence(F.lit(1), F.char_length(digits)),
        lambda i: let(
            F.substring(digits, -i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)),
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _iban_sums(text: Column) -> Column:
    """Whether the number with letters from 10 on, its first four characters last, leaves 1 when divided by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def rest(own: Column) -> Column:
        codes = F.transform(
            F.sequence(F.lit(1), F.char_length(own)),
            lambda i: let(
                F.ascii(F.substring(own, i, F.lit(1))), lambda c: F.when(c >= 65, c - 55).otherwise(c - 48)
            ),
        )
        return F.aggregate(
            codes, F.lit(0), lambda r, c: F.when(c > 9, (r * 100 + c) % 97).otherwise((r * 10 + c) % 97)
        )

    return let(turned, rest) == 1


def _form(kind: str, text: Column) -> Column:
    """The test of the form, for base kinds that of the contract."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return let(
            _digits(text), lambda d: F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
        )
    if kind == "phone":
        return F.char_length(_digits(text)).between(8, 15)
    if kind == "ssn":
        return ~text.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "iban":
        return _iban_sums(text)
    return F.lit(True)


def _gazetteer(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.substring_index(text, ".", -1)).isin(*DOMAINS), YES).otherwise(NO)
    if kind == "ip":
        return F.when(text.rlike(r"^(0|127|255)\."), NO).otherwise(NONE)
    if kind == "card":
        return F.when(text.rlike("^[3-6]"), YES).otherwise(NO)
    if kind == "phone":
        known = text.rlike(rf"^\+({'|'.join(CODES)})")
        return F.when(known, YES).otherwise(NO)
    if kind == "iban":
        return F.when(F.substring(text, 1, 2).isin(*COUNTRIES), YES).otherwise(NO)
    if kind == "person":
        return F.when(text.rlike(rf"\x20({'|'.join(NAMES)})\b"), YES).otherwise(NONE)
    return F.lit(NONE)


def _context(kind: str, before: Column) -> Column:
    return (
        F.when(before.rlike(rf"(?iu)\b({FOR[kind]})\b"), YES).when(before.rlike(rf"(?iu)\b({AGAINST})\b"), NO).otherwise(NONE)
    )


def _shape(text: Column) -> Column:
    """Length in four steps, and whether there is anything but letters and digits."""
    steps = F.least(F.floor(F.char_length(text) / 8).cast("int"), F.lit(3))
    return steps * 2 + F.when(text.rlike("[^A-Za-z0-9]"), 1).otherwise(0)


def proposals(text: Column) -> Column:
    """Array of (kind, start, end, form, gazetteer, context, shape) of all that the patterns propose."""

    def of_kind(number: int, kind: str) -> Column:
        voted = F.transform(
            matches(text, PATTERNS[kind]),
            lambda m: F.struct(
                F.lit(number).alias("kind"),
                m["start"].alias("start"),
                (m["start"] + F.char_length(m["text"])).alias("end"),
                F.when(_form(kind, m["text"]), YES).otherwise(NO).alias("form"),
                _gazetteer(kind, m["text"]).alias("gazetteer"),
                _context(kind, m["before"]).alias("context"),
                _shape(m["text"]).alias("shape"),
            ),
        )
        # numbers of a few digits are no proposals of a card
        voted = F.filter(voted, lambda p: p["end"] - p["start"] >= 13) if kind == "card" else voted
        return F.coalesce(voted, F.array().cast(PROPOSALS))

    return F.concat(*(of_kind(n, k) for n, k in enumerate(KINDS)))


PROPOSALS = "array<struct<kind:int,start:int,end:int,form:int,gazetteer:int,context:int,shape:int>>"


@dataclass
class Model:
    """Log odds of each kind, of each vote for each kind, and of each shape for each kind."""

    bias: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    votes: list[list[float]] = field(default_factory=lambda: [[0.0] * 3 * len(KINDS) for _ in LABELERS])
    shapes: list[float] = field(default_factory=lambda: [0.0] * SHAPES * len(KINDS))

    def margin(self, kind: int, votes: tuple[int, ...], shape: int) -> float:
        own = self.bias[kind] + self.shapes[kind * SHAPES + shape]
        return own + sum(table[kind * 3 + v] for table, v in zip(self.votes, votes, strict=True))

    def probability(self, p: Column) -> Column:
        def values(numbers: list[float]) -> Column:
            return F.split(F.lit(" ".join(f"{n:.9g}" for n in numbers)), " ").cast("array<double>")

        margin = F.get(values(self.bias), p["kind"]) + F.get(values(self.shapes), p["kind"] * SHAPES + p["shape"])
        for table, labeler in zip(self.votes, LABELERS, strict=True):
            margin = margin + F.get(values(table), p["kind"] * 3 + p[labeler])
        return 1 / (1 + F.exp(-margin))


def posteriors(cells: list[tuple], rounds: int = 60, strength: float = 5.0) -> list[float]:
    """Expectation-maximisation: the probability that a cell (kind, votes, shape, count) is personal data.

    Labelers are taken to be independent given the truth. ``strength`` spans of prior opinion, that a labeler is right
    four times in five, keep rare kinds from drifting.
    """
    truth = [0.5] * len(cells)
    prior = {k: 0.5 for k in range(len(KINDS))}
    right = {(k, j, t): 0.8 if t else 0.2 for k in prior for j in range(len(LABELERS)) for t in (0, 1)}  # P(yes | truth)
    for _ in range(rounds):
        for c, (kind, votes, _, _) in enumerate(cells):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, vote in enumerate(votes):
                if vote != NONE:
                    yes, no = right[kind, j, 1], right[kind, j, 0]
                    odds += math.log(yes / no) if vote == YES else math.log((1 - yes) / (1 - no))
            truth[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        sums = {key: [strength * (0.8 if key[2] else 0.2), strength] for key in right}
        mass = {k: [strength / 2, strength] for k in prior}
        for (kind, votes, _, count), t in zip(cells, truth, strict=True):
            mass[kind][0] += t * count
            mass[kind][1] += count
            for j, vote in enumerate(votes):
                if vote != NONE:
                    for side, part in ((1, t), (0, 1 - t)):
                        sums[kind, j, side][0] += part * count * (vote == YES)
                        sums[kind, j, side][1] += part * count
        prior = {k: a / b for k, (a, b) in mass.items()}
        right = {key: min(0.99, max(0.01, a / b)) for key, (a, b) in sums.items()}
    return truth


def train(cells: list[tuple], truth: list[float], rounds: int = 200, rate: float = 0.5) -> Model:
    """Logistic regression of the posteriors on votes and shape, a cell weighing the logarithm of its count."""
    model = Model()
    weights = [math.log1p(count) for *_, count in cells]
    per_kind = [sum(w for w, c in zip(weights, cells, strict=True) if c[0] == k) or 1.0 for k in range(len(KINDS))]
    for _ in range(rounds):
        slopes = Model()
        for (kind, votes, shape, _), t, w in zip(cells, truth, weights, strict=True):
            margin = max(-30.0, min(30.0, model.margin(kind, votes, shape)))
            slope = (t - 1 / (1 + math.exp(-margin))) * w / per_kind[kind]
            slopes.bias[kind] += slope
            slopes.shapes[kind * SHAPES + shape] += slope
            for table, v in zip(slopes.votes, votes, strict=True):
                table[kind * 3 + v] += slope
        for own, change in (
            (model.bias, slopes.bias),
            (model.shapes, slopes.shapes),
            *zip(model.votes, slopes.votes, strict=True),
        ):
            for i, s in enumerate(change):
                own[i] += rate * s - 0.001 * own[i]
    return model


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of every row as an array of (kind, start, end, base), by kind and then start."""
    own = F.coalesce(F.col(text), F.lit(""))
    # most texts without a digit, an at sign or a title cannot hold anything
    possible = own.rlike(r"[0-9@]|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?|Don|Doña)\b")
    found = F.when(possible, proposals(own)).otherwise(F.array().cast(PROPOSALS))
    proposed = settle(docs.select(F.col(doc_id).alias("doc_id"), found.alias("found")))
    columns = ("kind", *LABELERS, "shape")
    counts = proposed.select(F.explode("found").alias("p")).groupBy(*(f"p.{c}" for c in columns)).count()
    # at most kinds x 27 x shapes rows
    cells = sorted((r["kind"], tuple(r[v] for v in LABELERS), r["shape"], r["count"]) for r in counts.collect())
    model = train(cells, posteriors(cells))
    n_base = len(BASE_KINDS)

    def is_base(p: Column) -> Column:
        return (p["kind"] < n_base) & (p["form"] == YES)

    kept = F.filter("found", lambda p: is_base(p) | (model.probability(p) >= ACCEPTED))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(kept),
        lambda p: F.struct(
            F.get(names, p["kind"]).alias("kind"),
            p["start"].alias("start"),
            p["end"].alias("end"),
            is_base(p).alias("base"),
        ),
    )
    return proposed.select("doc_id", spans.alias("spans"))
