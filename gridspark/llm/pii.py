r"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose candidate spans.  Labelers vote on each - shape (regex), checksum or range,
gazetteer, cue words before it, misleading words before it - with 1, 0 (abstain) or -1.  The
votes are counted over all documents by kind and pattern of votes; that table has at most
``kinds * 3^labelers * lengths`` rows whatever the input, and only it reaches the driver.
Expectation-maximisation estimates each labeler's reliability and every pattern's probability
from it, and a logistic classifier of votes, kind and length is fitted to those probabilities.
Its score, again an expression, decides on spans beyond the base ones, which always stay.

Defined results: a null text counts as empty and has no spans.  Rows are judged one by one, so
repeated rows get equal results, and ids may be null; further columns are ignored.  An added span that
overlaps a base span, or an earlier added one, is dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm import spans as S
from gridspark.llm.common import query, settle, table

KINDS = ["email", "ip", "card", "phone", "masked_email", "local_phone", "national_id", "iban", "person"]
BASE = 4  #: the first kinds are the base ones
ROUNDS, ACCEPT = 40, 0.8
LABELERS, LENGTHS = 5, 4

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_NAME = r"[A-Za-z0-9._%+-]"
#: Pattern of each kind and a literal that every match holds.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "masked_email": (rf"(?<!{_NAME}){_NAME}++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[](?:dot|DOT)[)\]]|\.)\x20?[A-Za-z0-9-]++)++", None),
    "local_phone": (r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])", None),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "person": (r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?", None),
}
#: Gazetteers.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca)$"
CALLING = r"^\+(?:1|7|20|27|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|3[068]|35)"
RESERVED = r"^(?:0+|127|255|2[4-5][0-9])\."
COUNTRIES = r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|GR|IE|IT|LU|NL|NO|PL|PT|SE)"
#: Cue words before a span.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b\W{0,3}\w*\W{0,3}$",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|from|login)\b\W{0,3}\w*\W{0,3}$",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta|payment)\b\W{0,3}\w*\W{0,3}$",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b\W{0,3}\w*\W{0,3}$",
    "national_id": r"(?i)\b(?:ssn|social|security|id)\b\W{0,3}\w*\W{0,3}$",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b\W{0,3}\w*\W{0,3}$",
    "person": r"(?i)\b(?:by|from|dear|with|name|von|par|por)\b\W{0,3}$",
}
CUES |= {"masked_email": CUES["email"], "local_phone": CUES["phone"]}
MISLEADING = r"(?i)\b(?:version|ver|isbn|issn|doi|order|invoice|part|serial|section|figure|page|no|id)\b\W{0,3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column | None:
    """The base rules' further conditions on a match; None where there are none."""
    digits = _digits(value)
    return {
        "ip": value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.char_length(digits).between(14, 19) & F.call_function("luhn_check", F.when(F.char_length(digits).between(14, 19), digits).otherwise("1")),
        "phone": F.char_length(digits).between(10, 15),
    }.get(kind)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``; else -1 where ``no`` (by default everywhere)."""
    return F.when(yes, 1).otherwise(-1 if no is None else F.when(no, -1).otherwise(0))


def votes(kind: str, m: Column) -> Column:
    """The labelers' votes on a match."""
    value, never = m["value"], F.lit(False)
    shape = _vote(~m["left"].rlike(r"[\p{L}\p{N}]$") & ~m["right"].rlike(r"^[\p{L}\p{N}]"))
    known = {
        "email": _vote(value.rlike(DOMAINS), never), "masked_email": _vote(value.rlike(DOMAINS), never), "phone": _vote(value.rlike(CALLING)),
        "card": _vote(value.rlike(ISSUERS)), "ip": _vote(never, value.rlike(RESERVED)), "iban": _vote(value.rlike(COUNTRIES)),
    }.get(kind, F.lit(0))
    further = valid(kind, value)
    checked = F.lit(0) if further is None else _vote(further)
    return F.array(shape, checked, known, _vote(m["left"].rlike(CUES[kind]), never), _vote(never, m["left"].rlike(MISLEADING)))


def candidates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``row, doc_id, found``: per row (by a number of its own) its candidates ``kind, start, end, base, votes, size``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("row", "doc_id", "text", *[S.matches(F.col("text"), p, needs).alias(f"m_{k}") for k, (p, needs) in PATTERNS.items()])
    rows = rows.select("row", "doc_id", *[S.pieces(F.col("text"), p, F.col(f"m_{k}")).alias(f"p_{k}") for k, (p, _) in PATTERNS.items()])
    rows = rows.select("row", "doc_id", *[f"p_{k}" for k in KINDS], *[S.offsets(F.col(f"p_{k}")).alias(f"o_{k}") for k in KINDS])

    def judged(kind):
        def one(m):
            further = valid(kind, m["value"])
            base = F.lit(KINDS.index(kind) < BASE) if further is None else further
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), votes(kind, m).alias("votes"),
                F.least(F.floor((m["end"] - m["start"]) / 8).cast("int"), F.lit(LENGTHS - 1)).alias("size"),
            )

        return F.transform(S.placed(F.col(f"p_{kind}"), F.col(f"o_{kind}")), one)

    return rows.select("row", "doc_id", F.concat(*[judged(k) for k in KINDS]).alias("found"))


def reliabilities(counts: list[tuple[int, tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[list[float], list[list[list[float]]]]:
    """Expectation-maximisation over (kind, votes, count): the probability of each row, and
    ``table[y][labeler][vote + 1]``, the labelers' votes given the truth ``y``."""
    p = [min(0.95, max(0.05, 0.5 + sum(v) / (2 * LABELERS))) for _, v, _ in counts]
    given: list[list[list[float]]] = []
    for _ in range(rounds):
        given = []
        for y in (0, 1):
            rows = []
            for lab in range(LABELERS):
                # reliable labelers are the prior belief; it also orders the two classes
                cell = [2.0, 2.0, 1.0] if y == 0 else [1.0, 2.0, 2.0]
                for (_, v, n), q in zip(counts, p):
                    cell[v[lab] + 1] += n * (q if y else 1 - q)
                rows.append([c / sum(cell) for c in cell])
            given.append(rows)
        prior: dict[int, list[float]] = {}
        for (k, _, n), q in zip(counts, p):
            both = prior.setdefault(k, [1.0, 1.0])
            both[0] += n * (1 - q)
            both[1] += n * q
        p = []
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0]) + sum(math.log(given[1][i][v[i] + 1] / given[0][i][v[i] + 1]) for i in range(LABELERS))
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p, given


def _features(kind: int, v: tuple[int, ...], size: int) -> list[int]:
    """Positions of the features that are 1."""
    return [*(3 * i + v[i] + 1 for i in range(LABELERS)), 3 * LABELERS + kind, 3 * LABELERS + len(KINDS) + size]


def classifier(rows: list[tuple[int, tuple[int, ...], int, float, float]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Logistic weights fitted to (kind, votes, size, count, probability); log counts as weights."""
    weights = [0.0] * (3 * LABELERS + len(KINDS) + LENGTHS)
    data = [(_features(k, v, s), math.log1p(n), p) for k, v, s, n, p in rows]
    total = sum(n for _, n, _ in data) or 1.0
    for _ in range(steps):
        slope = [-0.002 * w for w in weights]
        for on, n, p in data:
            miss = (p - 1 / (1 + math.exp(-sum(weights[i] for i in on)))) * n / total
            for i in on:
                slope[i] += miss
        weights = [w + rate * s for w, s in zip(weights, slope)]
    return weights


def train(found: DataFrame) -> list[float]:
    """The classifier's weights from the candidates of all documents."""
    one = found.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.size")
    counts = [(r["kind"], tuple(r["votes"]), r["size"], float(r["n"])) for r in one.groupBy("kind", "votes", "size").agg(F.count("*").alias("n")).orderBy("kind", "votes", "size").collect()]
    p, _ = reliabilities([(k, v, n) for k, v, _, n in counts])
    return classifier([(*c, q) for c, q in zip(counts, p)])


def score(c: Column, weights: list[float]) -> Column:
    """The classifier's log odds of a candidate."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    own = sum((F.get(w, F.get(c["votes"], i) + (3 * i + 1)) for i in range(LABELERS)), F.lit(0.0))
    return own + F.get(w, c["kind"] + 3 * LABELERS) + F.get(w, c["size"] + (3 * LABELERS + len(KINDS)))


def spans(found: DataFrame, weights: list[float], accept: float = ACCEPT) -> DataFrame:
    """``doc_id, base, added``: base spans, and those that the classifier adds; ``found`` is a written table."""
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    chosen = F.filter("found", lambda c: ~c["base"] & (score(c, weights) > math.log(accept / (1 - accept))))
    split = found.select("row", "doc_id", F.transform(F.filter("found", lambda c: c["base"]), plain).alias("base"), F.transform(chosen, plain).alias("more"))
    return split.join(S.apart(split), "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


@query("op2_weak_supervision_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle(candidates(table(spark, sf_dir, "documents")), "pii-candidates")
    out = spans(found, train(found))
    n = [S.count_of("base", k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return out.select("doc_id", *n, S.sha256(S.joined(F.col("base"), KINDS)).alias("base_sha256"), S.joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
