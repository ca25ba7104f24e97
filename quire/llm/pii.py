"""Personal data: fixed patterns, and further spans on which weak labelers agree; DataFrame functions only."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The patterns of base spans. Possessive repeats and the look-behinds find the same leftmost matches as
# the plain forms, in time linear in the text: a start inside a run of the same characters fails as the run's start did.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser patterns, whose matches the labelers vote on.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[({<](?:at|AT|arroba)[\])}>]\x20?|\x20(?:at|AT|arroba)\x20|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\x20?[\[({<](?:dot|DOT|punto|point|punkt)[\])}>]\x20?|\x20(?:dot|DOT|punto|point|punkt)\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}+(?:\x20?[\[({](?:dot|\.)[\])}]\x20?[0-9]{1,3}+){3}(?![0-9])",
    # a number in one piece or in fours may also stand beside another one, where the base pattern takes both for one and drops it
    "card": r"(?<![0-9])(?<![0-9][\x20._/-])[0-9](?:[\x20._/-]{0,2}+[0-9]){12,18}+(?![\x20._/-]?[0-9])|(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+.])(?<!\+[0-9]{1,3}[\x20-])(?:00[1-9][0-9]{0,2}[\x20.-]|1[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.])",
}
# Cheap tests that a text must pass before its matches of a pattern are marked.
MAYBE_BASE = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": "+"}
MAYBE_LOOSE = {
    "email": r"[A-Za-z0-9._%+-](?:\x20?[\[({<](?:at|AT|arroba)[\])}>]\x20?|\x20(?:at|AT|arroba)\x20|\x20?@\x20?)[A-Za-z0-9-]++(?:\x20?[\[({<](?:dot|DOT|punto|point|punkt)[\])}>]|\x20(?:dot|DOT|punto|point|punkt)\x20|\.)",
    "ip": r"[0-9]\x20?[\[({](?:dot|\.)[\])}]",
    "card": r"[0-9](?:[\x20._/-]{0,2}+[0-9]){12}",
    "phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
# The gazetteers.
TLDS = "com org net edu gov mil int info biz io co de fr es uk us ca au nz at ch it nl be se no fi dk pl pt br mx ar jp cn in ru eu example test"
CARD_PREFIX = r"^(?:4|5[0-9]|2[2-7]|3[0-9]|6[0-9])"
RESERVED_IP = r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])$"
# Words before a span that speak for it, or for something else.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|mailto|contact|write to|reach me|adresse|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|server|address|addr|client|login from|adresse|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|credit|visa|mastercard|amex|payment|carte|tarjeta|karte|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|ring|t[eé]l[eé]phone|tel[eé]fono|telefon|anruf|appelez|llame)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:look|arrive|meet|stay|was|is|be)\s*$",
    "ip": r"(?i)\b(?:version|ver|v|section|chapter|release|build|§)\.?\s*$",
    "card": r"(?i)\b(?:token|isbn|id|serial|hash|order|ref|tracking)\b\W*$",
    "phone": r"(?i)\b(?:token|isbn|id|serial|hash|order|ref|tracking|part)\b\W*$",
}
LABELERS = ("regex", "gazetteer", "context", "check")
#: What the span classifier knows besides: one kind of separator, none, a space inside, a word or sign right before, a cue close before.
SHAPE = ("uniform", "bare", "spaced", "glued", "near")
#: Characters before a span in which a cue is close.
CLOSE = 15
#: Characters before a span in which the context labeler looks.
CONTEXT = 40
#: Marks around matches while a text is cut, and the character that stands for it where the text itself has it.
MARK, INSTEAD = "", ""
ACCEPT = 0.8
ROUNDS = 60


def prefix_sums(values: Column) -> Column:
    """The sum of each value and those before it, in a logarithm of steps over the array."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))

    def step(sums: Column, s: Column) -> Column:
        far = F.least(F.pow(F.lit(2), s).cast("int"), F.size(sums))
        shifted = F.concat(F.array_repeat(F.lit(0), far), F.slice(sums, F.lit(1), F.size(sums) - far))
        return F.zip_with(sums, shifted, lambda a, b: a + b)

    return F.aggregate(steps, values, step)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * (F.pmod(i, F.lit(2)) + 1)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.pmod(F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add), F.lit(10)) == 0


def octets_fit(text: Column) -> Column:
    """Whether each run of digits is at most 255."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def holds(kind: str, piece: Column) -> Column:
    """What a match of a base pattern must fulfil besides."""
    n = F.length(digits(piece))
    return {"email": F.lit(True), "ip": octets_fit(piece), "card": n.between(16, 19) & luhn(digits(piece)), "phone": n.between(8, 15)}[kind]


def marked(text: Column, kind: str, base: bool) -> Column:
    """The text cut at the marks around each match; null if it can have none. Odd places hold the matches."""
    test = (MAYBE_BASE if base else MAYBE_LOOSE)[kind]
    may = F.contains(text, F.lit(test)) if base and kind in ("email", "phone") else F.rlike(text, F.lit(test))
    cut = F.split(F.regexp_replace(text, f"({(BASE if base else LOOSE)[kind]})", f"{MARK}$1{MARK}"), MARK)
    return F.when(may, cut)


def spans(cut: Column, ends: Column) -> Column:
    """start, end, piece and the characters before it, for each match of a cut text; ends are its pieces' ends."""
    places = F.when(F.size(cut) > 2, F.sequence(F.lit(1), F.size(cut) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            F.get(ends, i - 1).alias("start"),
            F.get(ends, i).alias("end"),
            F.get(cut, i).alias("piece"),
            F.substring(F.get(cut, i - 1), -CONTEXT, CONTEXT).alias("ahead"),
        ),
    )


def votes(kind: str, piece: Column, ahead: Column) -> list[Column]:
    """What each labeler says of a span: 1 for it, -1 against it, 0 if it abstains."""

    def vote(yes: Column, no: Column | None = None) -> Column:
        against = F.when(no, F.lit(-1)).otherwise(F.lit(0)) if no is not None else F.lit(-1)
        return F.when(yes, F.lit(1)).otherwise(against)

    number = digits(piece)
    n = F.length(number)
    context = F.when(F.rlike(ahead, F.lit(AGAINST[kind])), F.lit(-1)).when(F.rlike(ahead, F.lit(CUES[kind])), F.lit(1)).otherwise(F.lit(0))
    if kind == "email":
        regex = vote(F.rlike(piece, F.lit(r"^\S+@\S+$|[\[({<](?i:at|arroba)[\])}>]")))
        last = F.lower(F.regexp_extract(piece, "([A-Za-z0-9-]+)$", 1))
        gazetteer = vote(last.isin(*TLDS.split()))
        check = vote(~F.rlike(piece, F.lit(r"^[.\-]|\.\.")))
    elif kind == "ip":
        regex = vote(F.rlike(piece, F.lit(r"^(?:(?:0|[1-9][0-9]{0,2})\D+){3}(?:0|[1-9][0-9]{0,2})$")))
        gazetteer = vote(~F.rlike(F.regexp_extract(piece, "^([0-9]+)", 1), F.lit(RESERVED_IP)))
        check = vote(octets_fit(piece))
    elif kind == "card":
        regex = vote(F.rlike(piece, F.lit(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[^0-9]{1,2}[0-9]{4}){3}|[0-9]{4}[^0-9]{1,2}[0-9]{6}[^0-9]{1,2}[0-9]{5})$")))
        gazetteer = vote(F.rlike(number, F.lit(CARD_PREFIX)))
        check = vote(n.between(13, 19) & luhn(number))
    else:
        regex = vote(F.rlike(piece, F.lit(r"^(?:\+|00)|^(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$")))
        gazetteer = vote(F.rlike(piece, F.lit(r"^(?:\+|00)[1-9]|^(?:1[\x20.-])?\(?[2-9][0-9]{2}\)?[\x20.-][2-9]")))
        check = vote(n.between(10, 15), n < 8)
    return [regex, gazetteer, context, check]


def shape(kind: str, piece: Column, ahead: Column) -> list[Column]:
    """The features SHAPE of a span, each 0 or 1."""
    between = F.regexp_replace(piece, "[A-Za-z0-9]", "")
    close = F.substring(ahead, -CLOSE, CLOSE)
    found = [F.rlike(between, F.lit(r"(?s)^(.?)\1*$")), between == "", F.contains(piece, F.lit(" ")), F.rlike(ahead, F.lit(r"[A-Za-z0-9_#=/]$")), F.rlike(close, F.lit(CUES[kind]))]
    return [F.when(f, 1).otherwise(0) for f in found]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, start, end) and found (kind, start, end, base and votes of all spans), in one pass over the texts."""
    names = [(kind, base) for kind in KINDS for base in (True, False)]
    col = lambda kind, base: f"{kind}_{'base' if base else 'loose'}"
    rows = docs.select("doc_id", F.translate(text_or_empty(), MARK, INSTEAD).alias("text"))
    rows = rows.select("doc_id", *[marked(F.col("text"), k, b).alias(col(k, b)) for k, b in names])
    ends = [prefix_sums(F.transform(F.col(col(k, b)), F.length)).alias(f"{col(k, b)}_ends") for k, b in names]
    rows = rows.select("*", *ends)
    cut = [spans(F.col(col(k, b)), F.col(f"{col(k, b)}_ends")).alias(f"{col(k, b)}_spans") for k, b in names]
    rows = rows.select("doc_id", *cut)
    empty = F.array().cast(rows.schema["email_base_spans"].dataType)

    def voted(kind: str, base: bool) -> Column:
        own = F.coalesce(F.col(f"{col(kind, base)}_spans"), empty)
        kept = F.filter(own, lambda s: holds(kind, s["piece"])) if base else own
        names = (*LABELERS, *SHAPE)
        said = lambda s: [v.cast("int").alias(n) for n, v in zip(names, votes(kind, s["piece"], s["ahead"]) + shape(kind, s["piece"], s["ahead"]), strict=True)]
        return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), *said(s)))

    rows = rows.select("doc_id", *[voted(k, b).alias(col(k, b)) for k, b in names])

    def merged(kind: str) -> Column:
        base, loose = F.col(col(kind, True)), F.col(col(kind, False))
        # what is data of another kind already isn't a part of this one
        apart = F.filter(loose, lambda s: ~F.exists("whole", lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        return F.array_sort(F.concat(base, apart), lambda a, b: a["start"] - b["start"])

    rows = rows.withColumn("whole", F.concat(*[F.col(col(kind, True)) for kind in KINDS]))
    found = [merged(kind) for kind in KINDS]
    return rows.select("doc_id", F.concat(*found).alias("found"))


def expect(counts: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns: how likely each pattern's spans are personal data.

    Each labeler has a table of votes for true and for false spans. Pseudo-counts, weighing as 10 spans each, hold that
    a labeler votes rather right than wrong, so that few spans don't turn the classes round.
    """
    start = {1: {1: 0.7, 0: 0.2, -1: 0.1}, 0: {1: 0.25, 0: 0.25, -1: 0.5}}
    tables = [{z: dict(start[z]) for z in (0, 1)} for _ in LABELERS]
    share, total = 0.5, sum(counts.values())
    belief: dict[tuple[int, ...], float] = {}
    for _ in range(ROUNDS):
        for pattern in counts:
            odds = log(share / (1 - share)) + sum(log(t[1][v] / t[0][v]) for t, v in zip(tables, pattern, strict=True))
            belief[pattern] = 1 / (1 + exp(-max(-50.0, min(50.0, odds))))
        for j, table in enumerate(tables):
            for z in (0, 1):
                mass = {v: 10 * start[z][v] for v in (1, 0, -1)}
                for pattern, n in counts.items():
                    mass[pattern[j]] += n * (belief[pattern] if z else 1 - belief[pattern])
                table[z] = {v: m / sum(mass.values()) for v, m in mass.items()}
        share = (sum(n * belief[p] for p, n in counts.items()) + 5) / (total + 10)
    return belief


def classifier(counts: dict[tuple[int, ...], int], belief: dict[tuple[int, ...], float]) -> list[float]:
    """Logistic regression of the beliefs on votes and features of spans, with a ridge of 1: a weight for each and a bias.

    counts has a number of spans for each pattern of votes, with what features follow them; belief is that of the votes.
    """
    weights = [0.0] * (max(map(len, counts), default=len(LABELERS)) + 1)
    total = sum(counts.values()) + 1
    for _ in range(400):
        slope = [w / total for w in weights]
        for pattern, n in counts.items():
            x = (*pattern, 1)
            error = 1 / (1 + exp(-max(-50.0, min(50.0, sum(w * v for w, v in zip(weights, x, strict=True)))))) - belief[pattern[: len(LABELERS)]]
            slope = [s + n / total * error * v for s, v in zip(slope, x, strict=True)]
        weights = [w - s for w, s in zip(weights, slope, strict=True)]
    return weights


def learn(found: DataFrame) -> dict[str, list[float]]:
    """The weights of each kind's span classifier, from counts of patterns: at most 81 of votes by 32 of features reach the driver."""
    one = found.select(F.explode("found").alias("s"))
    names = (*LABELERS, *SHAPE)
    counted = one.groupBy("s.kind", *[f"s.{n}" for n in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    weights = {}
    for kind in KINDS:
        counts = {tuple(r[n] for n in names): r["n"] for r in counted if r["kind"] == kind}
        said: dict[tuple[int, ...], int] = {}
        for pattern, n in counts.items():
            said[pattern[: len(LABELERS)]] = said.get(pattern[: len(LABELERS)], 0) + n
        weights[kind] = classifier(counts, expect(said)) if counts else [0.0] * (len(names) + 1)
    return weights


def written(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def detect(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the hash are of base spans; spans has these and the added ones, as kind:start:end in code points, end
    exclusive, by kind and start. A null text counts as empty: no spans, the hash of an empty string. Rows that repeat
    get a row each; an empty table gives an empty result; other columns are not read.

    Base spans match a fixed pattern and its checks. Looser matches apart from all base spans are added if a
    classifier gives them `accept` or more: labelers (form, gazetteer, words ahead, check digits or ranges) vote on all
    spans, expectation-maximisation over the counts of vote patterns estimates how reliable each is, and the resulting
    beliefs train a logistic regression over the votes and over what a span looks like (SHAPE). Only counts leave the
    executors; texts are read once.
    """
    found = checkpoint(candidates(docs))
    weights = learn(found)

    def stays(s: Column) -> Column:
        score = F.lit(0.0)
        for kind, w in weights.items():
            linear = sum((s[n] * F.lit(x) for n, x in zip((*LABELERS, *SHAPE), w, strict=False)), F.lit(w[-1]))
            score = F.when(s["kind"] == kind, F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))).otherwise(score)
        return s["base"] | (score >= accept)

    base = F.filter("found", lambda s: s["base"])
    rows = found.select("doc_id", base.alias("base"), F.filter("found", stays).alias("kept"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("kept")).alias("spans"),
        (F.size("kept") - F.size("base")).cast("long").alias("n_added"),
    )
