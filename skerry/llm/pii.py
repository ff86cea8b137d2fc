"""PII: base patterns, and further spans chosen by boosted trees over candidates.

Method: high-recall generators propose spans that may overlap the base ones and one
another: numbers, addresses, secrets, IBANs, IPv6 addresses.  Boosted trees score each
candidate by its format, its check digits and its context; thresholds calibrated on
candidates that were kept out of training select what is added, for each generator.
The trees are fitted on the driver to a bounded sample of candidates, and run as
a ``CASE`` expression: the data meets DataFrame functions alone.

Base patterns are rewritten without changing what they match: possessive loops,
and starts only where a run starts, so that neither backtracking nor the regex
engine's stack grows with long runs.  Places are running sums taken in blocks, so
that a text's matches cost about their number, not its square.

Labels are weak.  Positive: base spans; written-out addresses; numbers of 10 to 13
digits behind a word for a phone; runs assigned to a name for a secret, or that begin
as keys of well-known services do; IBANs and IPv6 addresses that pass their checks.
Negative: other candidates that touch no base span, and, as hard cases, each secret
as it would stand without that name.  Since only what touches no base span can be
added, base spans are learned from once more without '+' and as written-out addresses,
and thresholds are calibrated on these copies and on what can be added.

Defined cases: a null text is empty and has no spans; repeated rows are returned
each; without candidates, or with labels of one sort, nothing is added; a generator
with fewer than ``LEAST`` positives to calibrate on adds nothing.  Positions count
code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, fresh, read_table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, in the order in which spans of one start are listed.
ALL_KINDS = (*KINDS, "secret", "iban", "ipv6")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of digits with single separators between them, of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.", "card": r"[0-9][\x20-]?[0-9][0-9\x20-]{12}", "phone": r"\+[0-9]",
    "number": r"[0-9][0-9\x20().-]{7}", "address": r"@|[(\[]at[)\]]", "secret": "[A-Za-z0-9_+/-]{16}", "iban": "[A-Z]{2}[0-9]{2}", "ipv6": ":[0-9A-Fa-f]{0,4}:",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_OK = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

#: High recall: runs that look like numbers, dotted quads, written-out addresses, keys.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])(?:\+|\()?[0-9](?:[\x20().-]{0,2}[0-9]){7,24}+(?![0-9A-Za-z])",
    "address": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|\x20?(?:\(at\)|\[at\])\x20?)(?:{_HOST}{{1,63}}+(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)){{1,8}}+[A-Za-z]{{2,24}}",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
}
NUMBER, ADDRESS, SECRET, IBAN, IPV6 = range(5)
CONTEXT = 24
HINTS = {
    "hint_phone": "(?i)tel|phone|call|fax|mobil", "hint_card": "(?i)card|visa|pay|konto|account|carte|tarjeta", "hint_mail": "(?i)mail|contact|write|correo|kontakt", "hint_net": "(?i)host|server|addr|http|\\bip\\b",
    "hint_secret": "(?i)token|secret|passw|api.?key|access.?key|private.?key|auth|credential|bearer|contrase|clave", "hint_hash": "(?i)commit|sha|md5|hash|digest|checksum|etag|uuid|revision", "assigned": r"[=:]\s*+[\"'`]?+$",
}
#: How keys of well-known services begin.
KNOWN_KEY = "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ)"
FEATURES = (
    "generator", "n_chars", "n_digits", "n_marks", "n_dots", "n_spaces", "n_groups", "first_digit", "has_plus", "has_paren", "written_out", "n_upper", "n_lower", "is_hex", "known_key", "checked", *HINTS,
)

#: Candidates learned from, by the smallest hashes of (doc_id, start); a third is kept for calibration.
SAMPLE = 20_000
#: Documents that candidates are learned from, by a hash of doc_id: bounds what tasks send to the driver.
SAMPLE_DOCUMENTS = 100_000
TREES, DEPTH, RATE = 24, 3, 0.3
PRECISION, LEAST = 0.995, 3
#: Values that a running sum takes together.
BLOCK = 128
SPAN = "array<struct<start: long, rank: int, end: long, kind: string>>"
_LONGS = "array<long>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _blocks(values: Column, kind: str) -> Column:
    n = F.size(values)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))).otherwise(_empty(f"array<{kind}>"))


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs ``op`` over all before it; ``zero`` is neutral.
    To append to an array copies it: done within blocks, and once over blocks."""

    def scan(array: Column) -> Column:
        start = F.struct(F.lit(zero).cast("long").alias("at"), _empty(_LONGS).alias("out"))
        return F.aggregate(array, start, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def over(local: Column) -> Column:
        firsts = scan(F.transform(local, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(local, firsts, lambda x, f: F.transform(x["out"], lambda v: op(f, v))))

    return let(F.transform(_blocks(values, _LONGS), scan), over)


def located(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<start, end, match, before>> of a pattern's leftmost non-overlapping
    matches.  The text between matches has their places: no function gives them.
    before: up to CONTEXT characters, behind the match before.  guard: a cheap
    pattern that finds something in every text that has a match."""
    kind = "array<struct<start: long, end: long, match: string, before: string>>"

    def place(found: Column) -> Column:
        pairs = F.zip_with(found["gaps"], found["matches"], lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"), F.substring(g, -CONTEXT, CONTEXT).alias("before"), m.alias("match")))
        whole = F.slice(pairs, F.lit(1), F.size(found["matches"]))  # the last gap is behind the last match
        return let(whole, placed)

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: p["g"] + p["m"]), 0, lambda a, b: a + b)
        return F.zip_with(pairs, before, lambda p, b: F.struct((b + p["g"]).alias("start"), (b + p["g"] + p["m"]).alias("end"), p["match"].alias("match"), p["before"].alias("before")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(guard), let(found, place)).otherwise(_empty(kind))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's check."""
    padded = F.lpad(number, 20, "0")
    total = F.lit(0)
    for i in range(20):  # the last digit stands as it is, every second before it is doubled
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else F.when(d < 5, 2 * d).otherwise(2 * d - 9))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP_OK)
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def _of_kind(matches: Column, kind: str) -> Column:
    return F.filter(matches, lambda m: valid(kind, m["match"]))


def _span(m: Column, rank: Column, kind: Column) -> Column:
    return F.struct(m["start"].alias("start"), rank.cast("int").alias("rank"), m["end"].alias("end"), kind.alias("kind"))


def with_base(df: DataFrame, text: Column, name: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the base spans in column ``name``, sorted by start and then by kind as
    listed; and the columns, added too, with the matches of each kind.  Steps are columns
    of their own: the analyzer gives up on deeply nested functions."""
    own = dict(zip(KINDS, fresh(df, *(f"{name}_{k}" for k in KINDS)), strict=True))

    def spans(rank: int, kind: str) -> Column:
        return F.transform(own[kind], lambda m: _span(m, F.lit(rank), F.lit(kind)))

    df = df.withColumns({own[k]: located(text, BASE[k], GUARDS[k]) for k in KINDS}).withColumns({own[k]: _of_kind(F.col(own[k]), k) for k in KINDS})
    return df.withColumn(name, F.array_sort(F.concat(*(spans(*k) for k in enumerate(KINDS))))), own


def described(generator: int, m: Column, base: bool = False) -> Column:
    """A match with its features and weak label."""
    s, d = m["match"], digits(m["match"])
    count = lambda cls: F.length(s) - F.length(F.regexp_replace(s, cls, ""))
    value = {
        "generator": F.lit(generator), "n_chars": F.length(s), "n_digits": F.length(d), "n_marks": count("[().-]"), "n_dots": count("[.]"),
        "n_spaces": count(" "), "n_groups": F.size(F.split(s, "[^0-9]+")), "first_digit": F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)),
        "has_plus": s.startswith("+").cast("int"), "has_paren": s.contains("(").cast("int"), "written_out": s.rlike("(?i)[(\\[](at|dot)[)\\]]").cast("int"),
        "n_upper": count("[A-Z]"), "n_lower": count("[a-z]"), "is_hex": s.rlike("^[0-9A-Fa-f]+$").cast("int"), "known_key": s.rlike(KNOWN_KEY).cast("int"), "checked": _checked(generator, s, d),
    } | {k: m["before"].rlike(v).cast("int") for k, v in HINTS.items()}
    is_phone = (value["hint_phone"] == 1) & value["n_digits"].between(10, 13) & (value["n_dots"] != 3)
    is_secret = (value["known_key"] == 1) | (value["hint_secret"] == 1) & (value["assigned"] == 1) & (value["hint_hash"] == 0)
    known = F.lit(True) if base else (is_phone, value["written_out"] == 1, is_secret, value["checked"] == 1, (value["checked"] == 1) & (value["n_digits"] >= 4))[generator]
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), known.cast("int").alias("label"), F.lit(int(base)).alias("base"), *(value[f].cast("int").alias(f) for f in FEATURES))


def _checked(generator: int, s: Column, d: Column) -> Column:
    """Whether check digits are right, or an address is whole; 0 where there are none."""
    if generator == NUMBER:
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False).cast("int")
    if generator == IBAN:
        bare = F.regexp_replace(s, " ", "")
        turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).when(c.rlike("[A-Z]"), acc * 100 + F.ascii(c) - 55).otherwise(acc) % 97)
        return (rest == 1).cast("int")
    if generator == IPV6:
        short = s.rlike("::") & ~s.rlike("::.*::|:::")
        return (short & (F.size(F.split(s, ":")) <= 8) | ~s.rlike("::") & ~s.startswith(":") & (F.size(F.split(s, ":")) == 8)).cast("int")
    return F.lit(0)


def with_candidates(df: DataFrame, text: Column, base: str, name: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with what the generators propose in column ``name``, features and weak
    labels included: those that ``keep`` accepts and that touch no base span."""
    own = fresh(df, *(f"{name}_{g}" for g in GENERATORS))
    far = (1 << 62) - 1

    def features(generator: int, column: str) -> Column:
        found = F.transform(column, lambda m: described(generator, m))
        return F.filter(found, keep) if keep else found

    df = df.withColumns({c: located(text, pattern, GUARDS[g]) for c, (g, pattern) in zip(own, GENERATORS.items(), strict=True)})
    df = df.withColumn(name, F.concat(*(features(*g) for g in enumerate(own)))).drop(*own)
    # base spans among what was found, by start: the furthest end so far, and the next start
    events, last, following = fresh(df, f"{name}_events", f"{name}_last", f"{name}_next")
    none = F.get(F.slice(name, F.lit(1), F.lit(0)), F.lit(0))  # a null of a candidate's type
    found = F.transform(name, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m.alias("m")))
    others = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), none.alias("m")))
    df = df.withColumn(events, F.when(F.size(name) > 0, F.array_sort(F.concat(others, found))).otherwise(F.slice(found, F.lit(1), F.lit(0))))
    is_base = lambda e: e["m"].isNull()
    df = df.withColumn(last, running(F.transform(events, lambda e: F.when(is_base(e), e["end"]).otherwise(0)), 0, F.greatest))
    df = df.withColumn(following, F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(is_base(e), e["start"]).otherwise(far))), far, F.least)))
    free = F.filter(F.arrays_zip(events, last, following), lambda z: ~is_base(z[events]) & (z[last] <= z[events]["start"]) & (z[following] >= z[events]["end"]))
    return df.withColumn(name, F.transform(free, lambda z: z[events]["m"])).drop(events, last, following)


class Trees:
    """Boosted regression trees for log loss, each a nested tuple
    (feature, threshold, low, high) with numbers for leaves."""

    def __init__(self) -> None:
        self.bias, self.trees, self.thresholds = 0.0, [], {}

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_walk(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, c: Column) -> Column:
        total = F.lit(float(self.bias))
        for t in self.trees:
            total = total + _as_column(t, c)
        return total


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _walk(low, x), _walk(high, x))


def _as_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(c[FEATURES[f]] <= cut, _as_column(low, c)).otherwise(_as_column(high, c))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    leaf = float(RATE * g.sum() / (h.sum() + 1.0))
    if not depth or len(x) < 20:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16), method="lower")):
            low = x[:, f] <= cut
            gl, hl = g[low].sum(), h[low].sum()
            won = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
            if won > gain and low.any() and not low.all():
                best, gain = (f, float(cut), low), won
    if best is None:
        return leaf
    f, cut, low = best
    return (f, cut, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def disguised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features of base spans as they would be without '+', or with an
    address written out (`` (at) `` and `` (dot) ``); and which rows they came from."""
    at = {f: i for i, f in enumerate(FEATURES)}
    plus, address = np.flatnonzero(x[:, at["has_plus"]] == 1), np.flatnonzero(x[:, at["generator"]] == ADDRESS)
    phones, mails = x[plus].copy(), x[address].copy()
    phones[:, at["has_plus"]] = 0
    phones[:, at["n_chars"]] -= 1
    phones[:, at["n_groups"]] -= 1  # what stands before the first digit is none any more
    dots = mails[:, at["n_dots"]].copy()
    mails[:, at["written_out"]] = mails[:, at["has_paren"]] = 1
    mails[:, at["n_chars"]] += 5 + 6 * dots
    mails[:, at["n_marks"]] += 2 + dots
    mails[:, at["n_spaces"]] += 2 + 2 * dots
    mails[:, at["n_dots"]] = 0
    return np.concatenate([phones, mails]), np.concatenate([plus, address])


def unnamed(x: np.ndarray) -> np.ndarray:
    """Rows of features of secrets as they would be without a name for one, or a known beginning."""
    x = x.copy()
    for f in ("hint_secret", "assigned", "known_key"):
        x[:, FEATURES.index(f)] = 0
    return x


def fit_trees(x: np.ndarray, y: np.ndarray, base: np.ndarray | None = None) -> Trees | None:
    """Boost on two thirds of the rows; for each generator the lowest threshold at
    which the rest shows PRECISION, or none at all.  base: which rows are base
    spans, whose disguised copies are added and stand in for them at calibration;
    of secrets copies without their name are added as negatives."""
    held = np.arange(len(y)) % 3 == 2
    base = np.zeros(len(y), bool) if base is None else base
    more, source = disguised(x[base])
    secret = np.flatnonzero((y == 1) & (x[:, 0] == SECRET))
    source = np.concatenate([np.flatnonzero(base)[source], secret])
    addable = np.concatenate([~base, np.ones(len(source), bool)])
    y = np.concatenate([y, np.ones(len(more)), np.zeros(len(secret))])
    x = np.concatenate([x, more, unnamed(x[secret])])
    held = np.concatenate([held, held[source]])
    if len(set(y[~held].tolist())) < 2:
        return None
    model = Trees()
    p = y[~held].mean()
    model.bias = float(np.log(p / (1 - p)))
    raw = np.full((~held).sum(), model.bias)
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-raw))
        tree = _grow(x[~held], y[~held] - q, q * (1 - q), DEPTH)
        model.trees.append(tree)
        raw += _walk(tree, x[~held])
    judged = held & addable
    scores = model.raw(x[judged])
    for kind in range(len(GENERATORS)):
        own = x[judged][:, 0] == kind
        s, t = scores[own], y[judged][own]
        if t.sum() < LEAST:
            continue
        order = np.argsort(-s)
        right = np.cumsum(t[order]) / np.arange(1, len(s) + 1)
        good = np.flatnonzero((right >= PRECISION) & (np.append(s[order][1:], -np.inf) < s[order]))
        if len(good):
            last = good[-1]
            # half way to the next score below: what is a little less like a span still counts
            model.thresholds[kind] = float((s[order][last] + s[order][last + 1]) / 2 if last + 1 < len(s) else s[order][last])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, documents: int = SAMPLE_DOCUMENTS) -> Trees | None:
    share = documents / max(1, docs.count())
    if share < 1:
        docs = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, own = with_base(rows, F.col("text"), "base")
    rows = with_candidates(rows, F.col("text"), "base", "found")

    def known(kind: str) -> Column:
        return F.transform(own[kind], lambda m: described(ADDRESS if kind == "email" else NUMBER, m, True))

    rows = rows.select("doc_id", F.inline(F.concat("found", *map(known, KINDS))))
    taken = rows.select(F.xxhash64("doc_id", "start", "end").alias("order"), "label", "base", *FEATURES).orderBy("order", "base", *FEATURES).limit(sample).toPandas()
    return fit_trees(taken[list(FEATURES)].to_numpy(float), taken["label"].to_numpy(float), taken["base"].to_numpy() == 1) if len(taken) else None


def with_spans(df: DataFrame, text: Column, model: Trees | None, base: str, name: str) -> DataFrame:
    """``df`` with base spans in column ``base``, and in column ``name`` those and what
    the model adds, sorted by start and kind; other columns as they were."""
    rows, own = with_base(df, text, base)
    rows = rows.drop(*own.values())
    if model is None or not model.thresholds:
        return rows.withColumn(name, F.col(base))
    limits = F.lit([model.thresholds.get(g, 1e300) for g in range(len(GENERATORS))])
    rows = with_candidates(rows, text, base, name, lambda c: model.column(c) >= F.element_at(limits, c["generator"] + 1))
    names = F.array(*map(F.lit, ALL_KINDS))

    def rank(c: Column) -> Column:
        number = F.when(c["n_dots"] == 3, 1).when(c["n_digits"] >= 14, 2).otherwise(3)
        return F.when(c["generator"] == NUMBER, number).when(c["generator"] == ADDRESS, 0).otherwise(c["generator"] + 2)

    extra = F.transform(name, lambda c: _span(c, rank(c), F.element_at(names, rank(c) + 1)))
    return rows.withColumn(name, F.array_sort(F.concat(base, extra)))


def tagged(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (start, rank, end, kind);
    columns of these names are replaced."""
    own = docs.drop("pii_base", "pii_spans")
    return with_spans(own, F.coalesce(F.col("text"), F.lit("")), model, "pii_base", "pii_spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_masks(df: DataFrame, spans: str, name: str) -> DataFrame:
    """``df`` with its text in column ``name``, each of the sorted spans replaced by its
    kind in brackets; one that overlaps an earlier one has its mark behind that one's.
    A block's text is cut from the whole text once, and its pieces from that."""
    text, (ends, blocks) = F.col("text"), fresh(df, f"{name}_ends", f"{name}_blocks")
    kind = "array<struct<start: long, at: long, kind: string>>"

    def cut(x: Column) -> Column:
        first, last = F.element_at(x, 1)["at"], F.element_at(x, -1)
        part = F.substring(text, (first + 1).cast("int"), (F.greatest(last["at"], last["start"]) - first).cast("int"))
        return F.struct(x.alias("x"), first.alias("first"), part.alias("part"))

    def marked(b: Column) -> Column:
        gap = lambda e: F.greatest(e["start"] - e["at"], F.lit(0).cast("long")).cast("int")
        return F.array_join(F.transform(b["x"], lambda e: F.concat(F.substring(b["part"], (e["at"] - b["first"] + 1).cast("int"), gap(e)), F.lit("["), F.upper(e["kind"]), F.lit("]"))), "")

    df = df.withColumn(ends, running(F.transform(spans, lambda e: e["end"]), 0, F.greatest))
    zipped = F.zip_with(spans, ends, lambda e, b: F.struct(e["start"].alias("start"), b.alias("at"), e["kind"].alias("kind")))
    df = df.withColumn(blocks, zipped).withColumn(blocks, F.transform(_blocks(F.col(blocks), kind), cut))
    rest = F.substring(text, (F.array_max(F.transform(spans, lambda e: e["end"])) + 1).cast("int"), F.lit((1 << 31) - 1))
    return df.withColumn(name, F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(blocks, marked), ""), rest)).otherwise(text)).drop(ends, blocks)


def redacted(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets.  ``n_chars``, where
    there is one, follows a text that has spans; a null text stays null.  Columns of any
    other name stay as they are."""
    base, spans, new = fresh(docs, "base", "spans", "new")
    rows = with_masks(with_spans(docs, F.coalesce(F.col("text"), F.lit("")), model, base, spans), spans, new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.withColumn("text", F.col(new)).select(*columns(docs.columns))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = tagged(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", *(_count(k) for k in KINDS), F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
