"""Personal data: high-recall candidates, boosted trees over format and context, calibrated thresholds.

Everything that touches documents is DataFrame functions. Base patterns give spans that always
stay. Wider generators propose further candidates that overlap each other and the base spans: every
run of digit groups as a whole, without its first group and without its last, and masked e-mail
addresses. Gradient-boosted trees score each from its format and surroundings; what touches a base
span has lost to it, and of the candidates of one run the surest over its calibrated threshold is
added. The trees are fitted once per process on rule-made examples (no corpus row is read for that)
and compiled into CASE expressions.

Patterns are written with possessive groups, which Java's engine runs without recursion, and look
back to the start of a run of characters, which keeps long runs linear; both leave the leftmost
non-overlapping matches as they are.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Base patterns by kind, and a cheap test that a text can hold a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Wider generators: seven digits or more in groups, and addresses with a masked sign.
DIGITS = r"\+?\(?[0-9](?:[\x20().\x2F-]{0,2}+[0-9]){6,}+"
DIGITS_HINT = r"[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6}"
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({](?i:at|@)[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({](?i:dot|\.)[\])}]\x20?)[A-Za-z0-9-]++)++"
MASKED_HINT = r"[\[({](?i:at|@)[\])}]"

#: Code points of context before and after a candidate.
BEFORE, AFTER = 24, 8
#: Words around a candidate that speak for a phone, for a card, and against both.
CUES = {
    "cue_phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|rufnummer|handy|llamar|llame|appelez)",
    "cue_card": r"(?i)\b(?:card|visa|amex|mastercard|credit|debit|karte|tarjeta|carte)",
    "cue_other": r"(?i)(?:\b(?:version|order|invoice|isbn|date|id|page|ref|no|nr|build|ticket|since|lot)\b|[#$€v])",
}

NUMBER_FEATURES = ("digits", "groups", "longest", "plus", "paren", "dot", "dash", "blank", "slash", "luhn", "zeros", "lead3", "cue_phone", "cue_card", "cue_other", "glued", "more_before", "more_after")
MAIL_FEATURES = ("local", "dots", "tld", "glued")

#: What a candidate is without when its first or last group goes, and the digits that must be left.
HEAD, TAIL, LEAST_DIGITS = r"^\+?\(?[0-9]+[^0-9]+", r"[^0-9]+[0-9]+$", 7
#: A digit group right before a candidate, and right after it.
MORE_BEFORE, MORE_AFTER = r"[0-9][\x20().\x2F-]{1,2}$", r"^[\x20().\x2F-]{1,2}[0-9]"
#: Elements of an array that grows; longer ones are put together from such blocks, so that the work stays linear.
GROWING = 256


# --- boosted trees -----------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees of ``(feature, threshold, left, right)`` nodes over leaves of log odds, and a threshold."""

    features: tuple[str, ...]
    base: float
    trees: list
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _walk(tree, x)
        return out

    def sql(self, features: str) -> str:
        """The log odds as one expression; ``features`` is the struct that has them. Text is parsed once, where columns would take a call to the JVM for each node."""

        def node(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            i, cut, left, right = tree
            return f"CASE WHEN {features}.{self.features[i]} <= {float(cut)!r}D THEN {node(left)} ELSE {node(right)} END"

        return " + ".join([f"{float(self.base)!r}D", *map(node, self.trees)])


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    i, cut, left, right = tree
    return np.where(x[:, i] <= cut, _walk(left, x), _walk(right, x))


def fit_boosted(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], rounds: int = 24, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Gradient boosting with Newton leaves on the logistic loss; every distinct value of a feature is tried as a cut."""

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        value = float(rate * g[rows].sum() / (h[rows].sum() + 1))
        if not left or len(rows) < 20:
            return value
        best, whole = (1e-3, None), g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for i in range(x.shape[1]):
            values, at = np.unique(x[rows, i], return_inverse=True)
            gl, hl = (np.cumsum(np.bincount(at, part[rows], len(values)))[:-1] for part in (g, h))
            if not len(gl):
                continue
            gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - whole
            if gain.max() > best[0]:
                best = (gain.max(), (i, float(values[gain.argmax()])))
        if best[1] is None:
            return value
        i, cut = best[1]
        low = x[rows, i] <= cut
        return (i, cut, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(features, float(np.log(share / (1 - share))), [])
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        model.trees.append(tree)
        margin += _walk(tree, x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, precision: float) -> None:
    """The lowest log odds at which the other fold's precision is at least so high."""
    margin = model.margin(x)
    order = np.argsort(-margin)
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(margin[order][1:] != margin[order][:-1], True)  # equal odds are accepted together
    good = np.flatnonzero((right >= precision) & last)
    model.threshold = float(margin[order[good[-1]]]) if len(good) else float("inf")


# --- rule-made examples ------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def number_features(text: str, before: str, after: str) -> list[float]:
    """The features of a digit candidate; ``_number_sql`` states the same in SQL."""
    digits, groups = re.sub("[^0-9]", "", text), re.findall("[0-9]+", text)
    cues = [float(bool(re.search(CUES[c], before))) for c in ("cue_phone", "cue_card", "cue_other")]
    return [
        len(digits), len(groups), max(map(len, groups)), float(text.startswith("+")), float("(" in text), text.count("."), text.count("-"), text.count(" "), text.count("/"),
        float(luhn(digits)), float(digits.startswith("00")), float(int(digits[:3])), *cues, float(bool(re.search("[A-Za-z0-9]$", before) or re.match("[A-Za-z0-9]", after))),
        float(bool(re.search(MORE_BEFORE, before))), float(bool(re.search(MORE_AFTER, after))),
    ]


def variants(text: str, before: str, after: str) -> list[tuple[str, str, str]]:
    """A run of digit groups as a whole, without its first and without its last group, with context; ``_variants`` states the same in SQL."""
    out = [(text, before, after)]
    for pattern, first in ((HEAD, True), (TAIL, False)):
        if cut := re.search(pattern, text):
            rest = text[cut.end() :] if first else text[: cut.start()]
            if len(re.sub("[^0-9]", "", rest)) >= LEAST_DIGITS:
                out.append((rest, (before + cut[0])[-BEFORE:], after) if first else (rest, before, (cut[0] + after)[:AFTER]))
    return out


def mail_features(text: str, before: str, after: str) -> list[float]:
    local = re.match(r"[A-Za-z0-9._%+-]+", text)[0]
    last = re.search(r"[A-Za-z0-9-]+$", text)[0]
    return [len(local), len(re.findall(r"(?i)dot|\.", text)), len(last), float(bool(re.match("[A-Za-z0-9]", after)))]


def _fill(rng: random.Random, form: str) -> str:
    return re.sub("d", lambda _: str(rng.randrange(10)), form)


def _with_luhn(rng: random.Random, form: str) -> str:
    while not luhn(re.sub("[^0-9]", "", text := _fill(rng, form))):
        pass
    return text


PHONES = ("(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "00dd ddd ddddddd", "00dd dd dddd dddd", "+dd (0)dd ddd dddd", "0dd dddd dddd", "0dd/ddddddd", "(0dd) dddddddd")
CARDS = ("3ddd dddddd ddddd", "3ddd-dddddd-ddddd", "3dddddddddddddd", "4dddddddddddd", "36dd dddddd dddd", "4ddd.dddd.dddd.dddd", "5ddd/dddd/dddd/dddd")
OTHERS = ("20dd-0d-1d", "20dd/0d/1d", "1d.0d.20dd", "20dd-0d-1d 1d", "ddddddd", "dddddddd", "dddddddddd", "dddddddddddd", "1ddd-1ddd", "19dd-20dd", "978-d-dddd-dddd-d", "d.ddddddd", "dd.dd.dd.dd", "d.d.ddddd", "ddd.ddd.ddd", "ddd ddd ddd", "dddd dddd dddd dddd", "ddddddddddddd", "ddddddddddddddd", "dddddddddddddddddddddd", "dd/dd/dd/dd")


def examples(seed: int, n: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features and labels of rule-made numbers, and of masked addresses."""
    rng = random.Random(seed)
    cue = {"phone": ("phone ", "call ", "tel. ", "mobile: ", "fax "), "card": ("card ", "visa ", "credit card: ", "amex "), "other": ("order ", "version ", "id ", "ref ", "since ", "no ", "#", "date ")}
    rows, kinds = [], []
    for _ in range(n):
        kind = rng.choice(("phone", "card", "other", "other"))
        text = _with_luhn(rng, rng.choice(CARDS)) if kind == "card" else _fill(rng, rng.choice(PHONES if kind == "phone" else OTHERS))
        said = rng.random() < 0.75
        # other numbers stand near words for phones and cards too
        near = rng.choice(("phone", "card")) if kind == "other" and rng.random() < 0.3 else kind
        before = rng.choice(cue[near]) if said else "lorem ipsum "
        after = rng.choice((" dolor", ".", ", ", "")) if kind != "other" or rng.random() < 0.8 else "x"
        # without a cue only formats that nothing else has are called personal data
        sure = said or kind == "phone" and text[0] in "(+" or kind == "card" and len(text) in (15, 17) and text[0] == "3"
        known = kind if sure else "other"
        # another number may stand right before or after; then the whole run is none, and a part of it is
        beside = rng.random()
        run = f"{rng.randrange(100)} {text}" if beside < 0.15 and text[0].isdigit() else f"{text} {rng.randrange(100)}" if beside > 0.85 else text
        if run != text:
            known = kind if said else "other"
        for part, left, right in variants(run, before, after):
            rows.append(number_features(part, left, right))
            kinds.append(known if part == text else "other")
    x, y = np.array(rows), np.array(kinds)
    mails, is_mail = [], []
    for _ in range(n // 4):
        local, host, tld = ("".join(rng.choice("abcdefghij") for _ in range(k)) for k in (rng.randint(2, 12), rng.randint(3, 10), rng.choice((2, 3, 3, 4))))
        good = rng.random() < 0.7
        text = f"{local} [at] {host}{rng.choice((' [dot] ', '.'))}{tld if good else tld * 4}"
        mails.append(mail_features(text, "", " " if good or rng.random() < 0.5 else "x"))
        is_mail.append(float(good))
    return {"x": x}, {k: (y == k).astype(float) for k in ("phone", "card")}, np.array(mails), np.array(is_mail)


@cache
def models(seed: int = 7, n: int = 3_000, precision: float = 0.99) -> dict[str, Boosted]:
    """A model for each kind that has wider candidates; ``n`` examples to fit, as many to calibrate."""
    (x, y, m, mail), (x2, y2, m2, mail2) = examples(seed, n), examples(seed + 1, n)
    out = {}
    for kind in ("phone", "card"):
        out[kind] = fit_boosted(x["x"], y[kind], NUMBER_FEATURES)
        calibrate(out[kind], x2["x"], y2[kind], precision)
    out["email"] = fit_boosted(m, mail, MAIL_FEATURES)
    calibrate(out["email"], m2, mail2, precision)
    return out


# --- columns -----------------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_column(digits: Column) -> Column:
    """Whether the check digit is right, for at most 64 digits."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return F.when((n >= 1) & (n <= 64), total % 10 == 0).otherwise(F.lit(False))


def _found(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """(texts between the matches, matches); empty arrays where the hint finds nothing."""
    none = F.array().cast("array<string>")
    may = text.rlike(hint)
    return F.when(may, F.split(text, pattern, -1)).otherwise(none), F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _starts(parts: str, hits: str) -> Column:
    """Where each match begins: running sums, in blocks of ``GROWING``."""
    many = F.size(hits)

    def step(acc, i):
        start = acc["at"] + F.length(F.get(parts, i))
        return F.struct((start + F.length(F.get(hits, i))).alias("at"), F.array_append(acc["starts"], start).alias("starts"))

    def block(acc, k):
        own = F.sequence(k * GROWING, F.least((k + 1) * GROWING, many) - 1)
        inner = F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("starts")), step)
        return _let(inner, lambda v: F.struct(v["at"].alias("at"), F.array_append(acc["starts"], v["starts"]).alias("starts")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("starts"))
    blocks = F.sequence(F.lit(0), F.floor((many - 1) / GROWING).cast("int"))
    found = F.flatten(F.aggregate(blocks, first, block, lambda acc: acc["starts"]))
    return F.when(many > 0, found).otherwise(F.array().cast("array<int>"))


def _spans(parts: str, hits: str, more: bool = False) -> Column:
    """Structs of start, end and match; with ``more`` the context too. Code points, end exclusive."""
    return F.transform(
        F.arrays_zip(_starts(parts, hits).alias("s"), F.col(hits), F.slice(parts, 1, F.size(hits)), F.slice(parts, 2, F.size(hits))),
        lambda x: F.struct(
            x["s"].alias("start"),
            (x["s"] + F.length(x[hits])).alias("end"),
            x[hits].alias("text"),
            *([F.right(x["2"], F.lit(BEFORE)).alias("before"), F.left(x["3"], F.lit(AFTER)).alias("after")] if more else []),
        ),
    )


def _touches(span: str, others: str) -> str:
    """Whether ``span`` overlaps one of ``others``, which are in order and apart: a search by halves. SQL."""
    middle = "cast((acc.low + acc.high) div 2 AS int)"
    halve = f"""CASE WHEN acc.low >= acc.high THEN acc
        WHEN get({others}, {middle}).start < {span}.end THEN named_struct('low', {middle} + 1, 'high', acc.high)
        ELSE named_struct('low', acc.low, 'high', {middle}) END"""
    after = f"aggregate(sequence(0, cast(ceil(log2(size({others}) + 1)) AS int)), named_struct('low', 0, 'high', size({others})), (acc, i) -> {halve}, acc -> acc.low)"
    by_halves = f"coalesce(element_at(transform(array({after}), n -> n > 0 AND get({others}, n - 1).end > {span}.start), 1), false)"
    return f"CASE WHEN size({others}) <= 8 THEN exists({others}, b -> b.start < {span}.end AND {span}.start < b.end) ELSE {by_halves} END"


def _raw(pattern: str) -> str:
    """A pattern as an SQL literal without escapes."""
    return f"r'{pattern}'"


def _variants(c: str) -> str:
    """``variants`` of a candidate as an array of structs (start, end, text, before, after). SQL."""
    head, tail = (f"regexp_extract({c}.text, {_raw(x)}, 0)" for x in (HEAD, TAIL))
    later, sooner = f"substring({c}.text, length({head}) + 1)", f"substring({c}.text, 1, length({c}.text) - length({tail}))"
    enough = lambda t: f"length(regexp_replace({t}, '[^0-9]', '')) >= {LEAST_DIGITS}"
    made = lambda start, end, text, before, after: f"named_struct('start', {start}, 'end', {end}, 'text', {text}, 'before', {before}, 'after', {after})"
    whole = made(*(f"{c}.{k}" for k in ("start", "end", "text", "before", "after")))
    late = made(f"{c}.start + length({head})", f"{c}.end", later, f"right(concat({c}.before, {head}), {BEFORE})", f"{c}.after")
    soon = made(f"{c}.start", f"{c}.end - length({tail})", sooner, f"{c}.before", f"left(concat({tail}, {c}.after), {AFTER})")
    return f"filter(array({whole}, CASE WHEN {head} != '' AND {enough(later)} THEN {late} END, CASE WHEN {tail} != '' AND {enough(sooner)} THEN {soon} END), v -> v IS NOT NULL)"


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"


def _holds(kind: str, text: Column) -> Column:
    """The base condition of a match."""
    if kind == "ip":
        return text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        size = F.length(F.translate(text, " -", ""))
        return F.when(size.between(16, 19), luhn_column(F.translate(text, " -", ""))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _holder(kind: str):
    return lambda s: _holds(kind, s["text"])


def _named(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _number_sql(c: str) -> dict[str, str]:
    """The features of a digit candidate (text, before, after, and digits ``d``). SQL; ``number_features`` states the same."""
    flag = lambda x: f"CASE WHEN {x} THEN 1D ELSE 0D END"
    count = lambda mark: f"cast(length({c}.text) - length(translate({c}.text, '{mark}', '')) AS double)"
    groups, d = f"regexp_extract_all({c}.text, '[0-9]+', 0)", f"{c}.d"
    doubled = f"transform(sequence(1, length({d})), i -> cast(substring({d}, length({d}) - i + 1, 1) AS int) * if(i % 2 = 0, 2, 1))"
    return {
        "digits": f"cast(length({d}) AS double)",
        "groups": f"cast(size({groups}) AS double)",
        "longest": f"cast(array_max(transform({groups}, g -> length(g))) AS double)",
        "plus": flag(f"startswith({c}.text, '+')"),
        "paren": flag(f"contains({c}.text, '(')"),
        "dot": count("."),
        "dash": count("-"),
        "blank": count(" "),
        "slash": count("/"),
        "luhn": flag(f"length({d}) BETWEEN 1 AND 64 AND aggregate({doubled}, 0, (a, x) -> a + x - if(x > 9, 9, 0)) % 10 = 0"),
        "zeros": flag(f"startswith({d}, '00')"),
        "lead3": f"cast(substring({d}, 1, 3) AS double)",
        **{k: flag(f"{c}.before RLIKE {_raw(v)}") for k, v in CUES.items()},
        "glued": flag(f"{c}.before RLIKE '[A-Za-z0-9]$' OR {c}.after RLIKE '^[A-Za-z0-9]'"),
        "more_before": flag(f"{c}.before RLIKE {_raw(MORE_BEFORE)}"),
        "more_after": flag(f"{c}.after RLIKE {_raw(MORE_AFTER)}"),
    }


def _mail_sql(c: str) -> dict[str, str]:
    return {
        "local": f"cast(length(regexp_extract({c}.text, {_raw('^[A-Za-z0-9._%+-]+')}, 0)) AS double)",
        "dots": f"cast(size(regexp_extract_all({c}.text, {_raw(r'(?i)dot|[.]')}, 0)) AS double)",
        "tld": f"cast(length(regexp_extract({c}.text, {_raw('[A-Za-z0-9-]+$')}, 0)) AS double)",
        "glued": f"CASE WHEN {c}.after RLIKE '^[A-Za-z0-9]' THEN 1D ELSE 0D END",
    }


def _struct(values: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _scored(candidates: str, features, kind_models: dict[str, Boosted]) -> str:
    """Of each candidate's variants (an array of arrays) the surest as (kind number, start, end); of equally sure ones the longest. SQL."""
    over = ", ".join(_struct({"over": f"{m.sql('c.f')} - {m.threshold!r}D", "kind": str(KINDS.index(kind))}) for kind, m in sorted(kind_models.items()))
    rows = f"transform(own, c -> named_struct('start', c.start, 'end', c.end, 'text', c.text, 'before', c.before, 'after', c.after, 'd', regexp_replace(c.text, '[^0-9]', '')))"
    rows = f"transform({rows}, c -> named_struct('start', c.start, 'end', c.end, 'f', {_struct(features('c'))}))"
    rows = f"transform({rows}, c -> named_struct('best', array_max(array({over})), 'start', c.start, 'end', c.end))"
    rows = f"transform({rows}, c -> named_struct('over', c.best.over, 'size', c.end - c.start, 'place', -c.start, 'kind', c.best.kind, 'start', c.start, 'end', c.end))"
    won = f"filter(transform({candidates}, own -> array_max({rows})), c -> c.over >= 0)"
    return f"transform({won}, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))"


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of (kind number, start, end) by kind, then start.

    ``_base`` has the base patterns' spans; ``_added`` what the trees accept beyond them, which
    overlaps no base span and none of its own. Null and empty texts have none. Repeated rows each
    have theirs; of equally sure candidates the longest, then the first wins. The work is linear in
    the matches but for a search by halves, so a very long text of nothing but numbers is no trap.
    Columns of ``docs`` named like those added or like ``_text``, ``_email_hits`` and so on must be
    renamed before, as ``redact`` does. An empty table stays empty.
    """
    fitted = models()
    content = F.coalesce(F.col(text), F.lit(""))
    scan = docs.withColumn("_text", content)
    pairs = {f"_{k}": (BASE[k], HINT[k]) for k in KINDS} | {"_digits": (DIGITS, DIGITS_HINT), "_masked": (MASKED, MASKED_HINT)}
    named = {}
    for name, (pattern, hint) in pairs.items():
        named[f"{name}_parts"], named[f"{name}_hits"] = _found(F.col("_text"), pattern, hint)
    scan = scan.withColumns(named)
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = {f"_{kind}_base": F.when(F.size(f"_{kind}_hits") > 0, F.transform(F.filter(_spans(f"_{kind}_parts", f"_{kind}_hits"), _holder(kind)), _named(i))).otherwise(empty) for i, kind in enumerate(KINDS)}
    scan = scan.withColumns(base).withColumn("_base", F.concat(*base))

    free = lambda c, *others: "NOT (" + " OR ".join(f"({_touches(c, name)})" for name in others) + ")"
    wide = {f"{n}_wide": F.when(F.size(f"{n}_hits") > 0, _spans(f"{n}_parts", f"{n}_hits", more=True)) for n in ("_masked", "_digits")}
    scan = scan.withColumns(wide).withColumn("_masked_wide", F.expr(f"transform(filter(_masked_wide, c -> {free('c', *base)}), c -> array(c))"))
    mails = F.expr(_scored("_masked_wide", _mail_sql, {"email": fitted["email"]}))
    scan = scan.withColumn("_mails", F.when(F.size("_masked_wide") > 0, mails).otherwise(empty))
    scan = scan.withColumn("_digits_wide", F.expr(f"filter(transform(_digits_wide, c -> filter({_variants('c')}, v -> {free('v', *base, '_mails')})), own -> size(own) > 0)"))
    numbers = F.expr(_scored("_digits_wide", _number_sql, {k: fitted[k] for k in ("card", "phone")}))
    scan = scan.withColumn("_added", F.sort_array(F.concat("_mails", F.when(F.size("_digits_wide") > 0, numbers).otherwise(empty))))
    return scan.drop("_text", *named, *base, *wide, "_mails")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _merged(ordered: Column) -> Column:
    """Spans (start, end, kind) in order, overlapping ones made one of the first's kind; in blocks of ``GROWING``."""
    span = "struct<start:int,end:int,kind:int>"
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(-1).alias("kind"))

    def step(acc, s):
        last, full = acc["last"], F.size(acc["open"]) >= GROWING
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(last["end"] > s["start"], F.struct(acc["blocks"].alias("blocks"), acc["open"].alias("open"), grown.alias("last"))).otherwise(
            F.struct(
                F.when(full, F.array_append(acc["blocks"], acc["open"])).otherwise(acc["blocks"]).alias("blocks"),
                F.when(full, F.array(last)).otherwise(F.array_append(acc["open"], last)).alias("open"),
                s.alias("last"),
            )
        )

    first = F.struct(F.array().cast(f"array<array<{span}>>").alias("blocks"), F.array().cast(f"array<{span}>").alias("open"), none.alias("last"))
    every = F.aggregate(ordered, first, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["open"], F.array(acc["last"])))
    return F.filter(every, lambda s: s["kind"] >= 0)


def _replaced(text: Column, marks: str) -> Column:
    """``text`` with each of ``marks`` (start, end, kind) replaced by its kind, ``GROWING`` of them at a time."""
    names, many = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.size(marks)
    end_of = lambda i: F.coalesce(F.get(marks, i)["end"], F.lit(0))

    def block(k: Column) -> Column:
        low, high = k * GROWING, F.least((k + 1) * GROWING, many) - 1
        base = F.when(low > 0, end_of(low - 1)).otherwise(0)

        def piece(own: Column, i: Column) -> Column:
            m, since = F.get(marks, i), F.when(i > 0, end_of(i - 1)).otherwise(0)
            return F.concat(F.substring(own, since - base + 1, m["start"] - since), F.get(names, m["kind"]))

        own = F.substring(text, base + 1, end_of(high) - base)
        return _let(own, lambda t: F.array_join(F.transform(F.sequence(low, high), lambda i: piece(t, i)), ""))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((many - 1) / GROWING).cast("int")), block)
    return F.concat(F.array_join(blocks, ""), F.substring(text, end_of(many - 1) + 1, F.length(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null texts stay null.

    Overlapping spans become one mark, that of the first. Empty texts stay empty, very long ones
    are searched whole, repeated rows are each changed alike, an empty table stays empty. Other
    columns stay, whatever their names; the columns keep their order.
    """
    # plain names inside, so that no column of docs can clash with those of the search
    columns, at = docs.columns, docs.columns.index(text)
    docs, text = docs.toDF(*[f"c{i}" for i in range(len(columns))]), f"c{at}"
    found = find_spans(docs, text)
    ordered = F.sort_array(F.transform(F.concat("_base", "_added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn("_marks", F.when(F.size("_base") + F.size("_added") > 0, _merged(ordered)))
    clean = F.when(F.size("_marks") > 0, _replaced(F.col(text), "_marks")).otherwise(F.col(text))
    return found.select(*[(clean if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)])


def op9_pii(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, for each row of ``docs``.

    Null and empty texts have no spans (their digest is that of the empty string); very long texts,
    ties, repeated rows and empty tables as in ``find_spans``; a null doc_id stays null; further
    columns of ``docs`` are ignored.
    """
    found = find_spans(docs.select("doc_id", "text"))
    count = lambda i: F.size(F.filter("_base", lambda s: s["kind"] == i)).cast("long")
    every = F.sort_array(F.concat("_base", "_added"))
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _written(every).alias("spans"),
        F.size("_added").cast("long").alias("n_added"),
    )


#: The base matches, by Python's engine, for tests.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
