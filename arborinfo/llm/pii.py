"""Personal data: candidate spans, boosted trees over their format and context, redaction.

All of it is DataFrame and SQL expressions. Texts are cut into lines (no generator's pattern
reaches over a line end) and only lines with a digit or an at sign are looked at. Generators
propose spans: the four base patterns, whose valid matches always stay, and looser ones (keys,
assigned secrets, national numbers, phone numbers without a plus, masked addresses, digit groups
like cards). Every loose span gets a vector of binned features of its format and of the text
around it. Boosted depth-two trees over the features score the spans; a threshold for each kind,
calibrated on a half of the spans that the trees did not see, selects those to redact.

Nobody labels personal data here, so training labels come from checks: a span is positive when it
passes a structural check (checksum, number ranges, full address, key prefix, a name such as
``password`` or ``phone`` that it is assigned to), negative when it has the shape but fails. The
features see the span's format and the characters beside it, not that name: of secrets and phone numbers
the cue is the label's alone. Keys, national numbers, secrets and phone numbers that pass their check are
selected whatever the trees say (``CERTAIN``), so a kind without training rows is found too; the trees
extend that to spans of like format and context that fail or lack it. All documents take part. The features are binned, so the training table is a count by (features, kind,
half, label): its size is bounded by the number of bins (``VECTORS``) whatever the corpus.
Boosting runs over that table on the driver, and the trees become one SQL expression.

Base patterns are written with possessive quantifiers and anchors at the start of a run; they find
the same leftmost matches in linear time and without deep recursion in Java's matcher.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; added
spans inside a base span are dropped, other overlaps stay in the list and are merged when text is
redacted; without training rows of both labels there are no trees, and base spans and those of ``CERTAIN`` stay. Rows are
independent, so ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of span lists; the first four have base patterns.
KINDS = ["email", "ip", "card", "phone", "key", "national", "secret"]
NUMBER = {kind: k for k, kind in enumerate(KINDS)}

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that a line must have one of for the pattern of a kind to be tried; none for those not named.
BASE_NEEDS = {"email": ["@"], "phone": ["+"], "ip": ["."]}
LOOSE_NEEDS = {"email": ["@", "at]", "at)"], "ip": ["."]}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
LOOSE = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"),
    ("key", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"),
    ("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"""(?<=["'=:\x20])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_+/=-]{8,}+(?=["'\x20]|$)"""),
    ("secret", r"""(?i)(?<=(?:passwor[dt]|passwd|pwd)["']?\x20?[=:]\x20?["']?)(?=[^\s"',;0-9]*+[0-9])[^\s"',;]{4,}+"""),
]
#: A name and a sign after it to which a secret is assigned, directly before the secret.
ASSIGNED = r"""(?i)(?:(?:token|key|secret|passwor[dt]|passwd|pwd|auth)["']?\x20?[=:]\x20?["']?|bearer\x20["']?)$"""
#: Prefixes of keys that services give out.
KEY = "^(?:AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
#: Kinds of which a span that passes its check is always selected.
CERTAIN = ["phone", "key", "national", "secret"]
CUES = [
    r"(?i)(?:tel|phone|call|mobile|fax|contact|mail)[^A-Za-z0-9]{0,8}$",
    r"(?i)(?:token|key|secret|passwor[dt]|pwd|auth|bearer)[\x20\"'=:]{1,8}$",
    r"(?i)(?:card|visa|account|iban|ssn|passport)[^A-Za-z0-9]{0,8}$",
]
#: Upper bounds of the bins of each count; the last bin is open.
BINS = {"digits": [0, 3, 6, 8, 11, 15, 19], "letters": [0, 1, 3, 7, 15, 31], "signs": [0, 1, 2, 4], "distinct": [3, 6, 10, 15]}
FEATURES = ["kind", "digits", "letters", "signs", "distinct", "case", "before", "after", "cue"]
VECTORS = len(KINDS) * 8 * 7 * 5 * 5 * 4 * 4 * 4 * 4


def candidate_lines(text: Column) -> Column:
    """(pos, line) of the lines with a digit or an at sign."""
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<pos:int,line:string>>)").alias("out"))
    step = lambda acc, line: F.struct(
        (acc["pos"] + F.length(line) + 1).alias("pos"),
        F.when(
            line.rlike("[0-9@]|[\\[(]at[\\])]"),
            F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("pos"), line.alias("line")))),
        ).otherwise(acc["out"]).alias("out"),
    )
    lines = F.when(text.rlike("[0-9@]|[\\[(]at[\\])]"), F.split(text, "\n", -1)).otherwise(F.array(F.lit("")))
    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def matches(line: Column, kind: str, pattern: str, needs: dict[str, list[str]]) -> Column:
    """(kind, start, end, found) of the leftmost matches that do not overlap, in the line."""
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,found:string>>)")
    step = lambda acc, z: F.struct(
        (acc["pos"] + F.length(z["piece"]) + F.length(z["found"])).alias("pos"),
        F.concat(acc["out"], F.array(F.struct(
            F.lit(NUMBER[kind]).alias("kind"),
            (acc["pos"] + F.length(z["piece"])).alias("start"),
            (acc["pos"] + F.length(z["piece"]) + F.length(z["found"])).alias("end"),
            z["found"].alias("found"),
        ))).alias("out"),
    )
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(line, pattern, -1).alias("piece"), found.alias("found"))
    # There is one more piece than matches; its match is null.
    placed = F.aggregate(
        F.filter(pieces, lambda z: z["found"].isNotNull()),
        F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"],
    )
    needed = F.lit(True)
    if kind in needs:
        needed = F.lit(False)
        for sign in needs[kind]:
            needed = needed | F.contains(line, F.lit(sign))
    return F.when(needed & line.rlike(pattern), placed).otherwise(none)


def passes(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern is valid."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def shifted(span: Column, by: Column, *more: str) -> Column:
    return F.struct(
        span["kind"].alias("kind"), (span["start"] + by).alias("start"), (span["end"] + by).alias("end"),
        *[span[x].alias(x) for x in more],
    )


def base_spans(lines: Column, kind: str) -> Column:
    found = F.transform(lines, lambda c: F.transform(
        F.filter(matches(c["line"], kind, BASE[kind], BASE_NEEDS), lambda s: passes(kind, s["found"])),
        lambda s: shifted(s, c["pos"]),
    ))
    return F.flatten(found)


def binned(value: Column, bounds: list[int]) -> Column:
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def char_class(char: Column) -> Column:
    return (
        F.when(char.rlike(r"^\s?$"), 0).when(char.rlike("[A-Za-z0-9]"), 1)
        .when(char.rlike("[\"'=:]"), 2).otherwise(3)
    )


def described(span: Column, line: Column) -> Column:
    """The span with its features and its label."""
    found = span["found"]
    before = F.when(
        span["start"] > 0,
        F.substring(line, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24))),
    ).otherwise("")
    after = F.substring(line, span["end"] + 1, F.lit(1))
    upper, lower = F.length(F.regexp_replace(found, "[^A-Z]", "")), F.length(F.regexp_replace(found, "[^a-z]", ""))
    count = lambda name, value: binned(value, BINS[name]).alias(name)
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    named = F.when(before.rlike(CUES[0]), 1).when(before.rlike(CUES[1]), 2).when(before.rlike(CUES[2]), 3).otherwise(0)
    hidden = ((span["kind"] == NUMBER["phone"]) & (named == 1)) | ((span["kind"] == NUMBER["secret"]) & (named == 2))
    cue = F.when(hidden, 0).otherwise(named)
    label = F.lit(False)
    for kind, check in (
        ("email", found.rlike(f"^{BASE['email']}$")), ("ip", passes("ip", found)), ("card", passes("card", found)),
        ("phone", digits.between(9, 15) & (before.rlike(CUES[0]) | F.substring(before, -2, 2).rlike(r"^\+[0-9]$"))),
        ("key", found.rlike(KEY)),
        ("national", found.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")),
        ("secret", before.rlike(ASSIGNED)),
    ):
        label = F.when(span["kind"] == NUMBER[kind], check).otherwise(label)
    return F.struct(
        span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
        F.struct(
            span["kind"].alias("kind"), count("digits", digits), count("letters", upper + lower),
            count("signs", F.length(found) - digits - upper - lower),
            count("distinct", F.size(F.array_distinct(F.split(found, "")))),
            F.when((upper == 0) & (lower == 0), 0).when(lower == 0, 1).when(upper == 0, 2).otherwise(3).alias("case"),
            char_class(F.substring(before, -1, 1)).alias("before"), char_class(after).alias("after"),
            cue.alias("cue"),
        ).alias("features"),
        label.alias("label"),
        (F.pmod(F.xxhash64(found), F.lit(2)) == 0).alias("seen"),
    )


def loose_spans(lines: Column) -> Column:
    """Candidates of all generators, with features and labels, at their place in the text."""
    per_line = lambda c: F.transform(
        F.concat(*[matches(c["line"], kind, pattern, LOOSE_NEEDS) for kind, pattern in LOOSE]),
        lambda s: shifted(described(s, c["line"]), c["pos"], "features", "label", "seen"),
    )
    return F.flatten(F.transform(lines, per_line))


def with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_lines", candidate_lines(F.coalesce("text", F.lit(""))))


@dataclass
class Trees:
    """Boosted depth-two trees: (feature, bound, (feature, bound, low, high) twice) each."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, features: Column) -> Column:
        total = F.lit(self.start)
        for feature, bound, *sides in self.trees:
            low, high = (
                F.when(features[FEATURES[f]] <= b, F.lit(below)).otherwise(F.lit(above)) for f, b, below, above in sides
            )
            total = total + F.when(features[FEATURES[feature]] <= bound, low).otherwise(high)
        return total

    def selected(self, span: Column) -> Column:
        """Whether the span passes the check of its kind, or its score reaches the threshold of it."""
        certain = span["label"] & span["kind"].isin([NUMBER[kind] for kind in CERTAIN])
        if not self.trees:
            return certain
        bound = F.lit(float("inf"))
        for kind, value in sorted(self.thresholds.items()):
            bound = F.when(span["kind"] == kind, F.lit(value)).otherwise(bound)
        return certain | (self.margin(span["features"]) >= bound)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, bound, *sides in self.trees:
            low, high = (np.where(x[:, f] <= b, below, above) for f, b, below, above in sides)
            total += np.where(x[:, feature] <= bound, low, high)
        return total


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple:
    """(gain, feature, bound, value below, value above) by second-order gains."""
    value = lambda a, b: float(-a / (b + ridge))
    gain = lambda a, b: a * a / (b + ridge)
    top = (0.0, 0, 99, value(g.sum(), h.sum()), 0.0)
    for f in range(x.shape[1]):
        for bound in range(int(x[:, f].min(initial=99)), int(x[:, f].max(initial=0))):
            m = x[:, f] <= bound
            a, b = g[m].sum(), h[m].sum()
            c, d = g.sum() - a, h.sum() - b
            now = gain(a, b) + gain(c, d) - gain(a + c, b + d)
            if now > top[0] + 1e-9:
                top = (now, f, bound, value(a, b), value(c, d))
    return top


def boost(x, y, n, rounds: int = 24, rate: float = 0.5) -> Trees:
    """Logistic boosting over distinct vectors ``x`` with labels ``y`` and counts ``n``."""
    if not n[y == 1].sum() or not n[y == 0].sum():
        return Trees()
    out = Trees(start=float(np.log(n[y == 1].sum() / n[y == 0].sum())))
    margin = np.full(len(x), out.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = n * (p - y), n * p * (1 - p)
        _, f, bound, *_ = best_split(x, g, h)
        sides = []
        for part in (x[:, f] <= bound, x[:, f] > bound):
            _, f2, b2, low, high = best_split(x[part], g[part], h[part])
            sides.append((f2, b2, rate * low, rate * high))
        out.trees.append((f, bound, *sides))
        margin = out.margins(x)
    return out


def calibrate(trees: Trees, x, y, n, precision: float = 0.9, floor: float = 0.5) -> Trees:
    """For each kind the lowest threshold with that precision among the unseen spans."""
    margin = trees.margins(x)
    for kind in range(len(KINDS)):
        of = x[:, 0] == kind
        for bound in np.unique(margin[of]):
            at = of & (margin >= bound)
            if bound >= np.log(floor / (1 - floor)) and (n * y)[at].sum() >= precision * n[at].sum():
                trees.thresholds[kind] = float(bound) - 1e-9
                break
    return trees


def train(docs: DataFrame) -> Trees:
    """Trees and thresholds from the candidates of all documents."""
    spans = with_lines(docs.select("text")).select(F.explode(loose_spans(F.col("_lines"))).alias("s"))
    table = (
        spans.select(*[F.col("s.features")[f].alias(f) for f in FEATURES], "s.label", "s.seen")
        .groupBy(*FEATURES, "label", "seen").count()
        .orderBy(*FEATURES, "label", "seen")
        .collect()  # VECTORS x 4 rows at most
    )
    x = np.array([[r[f] for f in FEATURES] for r in table], np.int64).reshape(-1, len(FEATURES))
    y = np.array([int(r["label"]) for r in table], np.int64)
    n = np.array([r["count"] for r in table], np.float64)
    seen = np.array([r["seen"] for r in table], bool)
    trees = boost(x[seen], y[seen], n[seen])
    return calibrate(trees, x[~seen], y[~seen], n[~seen])


def find_personal_data(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with base_spans and all_spans: arrays of (kind, start, end), kinds as numbers."""
    names = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    kinds = [k for k in KINDS if k in BASE]
    base = with_lines(docs).select(
        *names, "_lines", F.concat(*[base_spans(F.col("_lines"), k) for k in kinds]).alias("base_spans")
    )
    added = F.transform(
        F.filter(loose_spans(F.col("_lines")), trees.selected),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    apart = lambda s: ~F.exists(
        F.col("base_spans"), lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
    )
    found = base.withColumn("_added", added)
    every = F.array_sort(F.array_distinct(F.concat("base_spans", F.filter("_added", apart))))
    return found.withColumn("all_spans", every).drop("_lines", "_added")


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def listed(spans: Column | str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    one = lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans give one."""
    mine = "_" * (1 + max(map(len, docs.columns)))  # a user's columns of these names keep their values
    kept = {c: mine + c for c in docs.columns if c in ("base_spans", "all_spans", "_lines", "_added")}
    found = find_personal_data(docs.withColumnsRenamed(kept), trees or train(docs))
    text = F.col("text")
    by_place = F.array_sort(F.transform("all_spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
    )))
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<string>)").alias("parts"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["pos"], s["end"]).alias("pos"),
        F.when(s["start"] >= acc["pos"], F.concat(acc["parts"], F.array(
            F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]),
            F.concat(F.lit("["), F.upper(kind_name(s["kind"])), F.lit("]")),
        ))).otherwise(acc["parts"]).alias("parts"),
    )
    whole = F.aggregate(by_place, start, step, lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["pos"] + 1, F.length(text))
    ))
    cleaned = found.withColumn("text", F.when(F.size("all_spans") > 0, whole).otherwise(text))
    return cleaned.select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])
