"""Personal data by weak supervision (operator 10).

Base detectors give exact spans of four kinds.  Candidates are these, what had
their form but failed their test, and the matches of wider patterns.  Three
labelers vote for or against each candidate or abstain: the regex labeler (the
form's test, if it has one), a gazetteer (registries of issuers, countries,
zones and reserved ranges) and the context (words before the span that speak
for its kind or for something else).  Expectation-maximisation over the counts
of all vote patterns in the corpus estimates each labeler's reliability and the
share of true spans per kind; a naive Bayes span classifier over votes and
shape is trained on its posteriors and decides which candidates are added.
Base spans always stay.  All work is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, written so that no part of a text is tried more often than there are groups.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Wider patterns: obfuscated addresses (found by their sign), colon-grouped addresses, national and 00-prefixed numbers, social security and bank account numbers.
_AT = re.compile(r"(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63})+\b")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
_COLONS = re.compile(r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b")
_NATIONAL = re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TRUNK = re.compile(r"(?<![0-9+.])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,6}){2,5}(?![0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")

# Words before a span that speak for its kind, in the corpus languages, and words that speak against any.
_CUES = {
    "email": ("mail", "contact", "correo", "write to", "courriel", "kontakt"), "ip": ("ip", "host", "server", "addr", "login from", "connected", "servidor", "serveur"),
    "card": ("card", "visa", "account", "ssn", "iban", "konto", "tarjeta", "carte", "karte", "social security", "cuenta", "compte"), "phone": ("phone", "tel", "call", "mobile", "fax", "teléfono", "téléphone", "móvil", "handy"),
}
_AGAINST = ("version", "release", "build", "section", "chapter", "figure", "isbn", "issn", "doi", "order", "invoice", "serial", "sku", "part no", "page", "ratio", "versión", "rechnung", "facture", "pedido", "seite")
# First four digits (from, to) and lengths of card issuers.
_ISSUERS = [
    (4000, 4999, (13, 16, 19)), (5100, 5599, (16,)), (2221, 2720, (16,)), (3400, 3499, (15,)), (3700, 3799, (15,)), (3000, 3059, (14, 16)), (3600, 3699, (14, 16)), (3800, 3999, (14, 16)), (6011, 6011, (16, 19)), (6440, 6599, (16, 19)),
    (3528, 3589, (16, 19)), (6200, 6299, (16, 17, 18, 19)), (5000, 5099, (14, 15, 16, 17, 18, 19)), (5600, 5899, (14, 15, 16, 17, 18, 19)), (6300, 6399, (16, 17, 18, 19)), (6700, 6799, (16, 17, 18, 19)), (2200, 2204, (16,)),
]
# Generic top-level domains; two letters are a country's unless reserved for private use.
_GENERIC = frozenset("com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat asia post xyz online site shop app dev blog cloud tech store club live news wiki page email".split())
_PRIVATE = re.compile(r"aa|q[m-z]|x[a-z]|zz")
# Account number lengths by country.
_ACCOUNTS = dict(
    zip(
        "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split(),
        (20, 16, 22, 21, 28, 24, 22, 18, 20, 24, 18, 27, 22, 27, 21, 28, 22, 26, 27, 21, 20, 20, 21, 27, 31, 18, 15, 28, 25, 24, 24, 19, 24, 27, 26),
    )
)
# Address ranges that name no host (first parts), and calling zones that are not assigned.
_NO_HOST = ((0,), (127,), (169, 254), (192, 0, 2), (198, 51, 100), (203, 0, 113), *((n,) for n in range(224, 256)))
_NO_ZONE = ("0", "28", "83", "89")
_CUE_WIDTH = 32
FEATURES = 4
LABELERS = 3
ROUNDS = 200
FOR, AGAINST, NONE = 1, 0, 2


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind number, end) of what the base detectors find, and of what has a kind's form but fails its test; sorted."""
    out, failed = [], []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out, failed
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))
        (out if ok else failed).append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19:
            (out if luhn(digits) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            ok = 10 <= sum(map(str.isdigit, m[0])) <= 15
            (out if ok else failed).append((m.start(), 3, m.end()))
    return sorted(out), sorted(failed)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base detectors, sorted."""
    return _matches(text)[0]


def checked_account(span: str) -> bool:
    """Whether a bank account number's check digits are right."""
    x = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _wide(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, the regex labeler's vote) of the wider patterns, sorted."""
    out = []
    for m in _AT.finditer(text) if "at)" in text or "at]" in text or " at " in text else ():
        name = _NAME.search(text, max(0, m.start() - 65), m.start())
        if name:
            out.append((name.start(), 0, m.end(), NONE))
    if _DIGIT.search(text):
        if ":" in text:
            out += [(m.start(), 1, m.end(), NONE) for m in _COLONS.finditer(text)]
        for kind, pattern in ((3, _NATIONAL), (3, _TRUNK), (2, _SOCIAL)):
            out += [(m.start(), kind, m.end(), NONE) for m in pattern.finditer(text)]
        out += [(m.start(), 2, m.end(), FOR if checked_account(m[0]) else AGAINST) for m in _ACCOUNT.finditer(text)]
    return sorted(out)


def _registered(kind: int, span: str) -> int:
    """The gazetteer's vote."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        ending = re.split(r"[.\s)\]]", span)[-1].lower()
        return int(ending in _GENERIC or len(ending) == 2 and ending.isalpha() and not _PRIVATE.fullmatch(ending))
    if kind == 1 and ":" in span:
        return int(span[0] in "23" and len(span.split(":")[0]) == 4 or span[:2].lower() in ("fc", "fd", "fe"))
    if kind == 1:
        parts = [int(p.lstrip("0")[:4] or 0) for p in span.split(".")]
        return int(not any(tuple(parts[: len(r)]) == r for r in _NO_HOST) and max(parts) > 9)
    if kind == 2 and span[:2].isalpha():
        return int(_ACCOUNTS.get(span[:2]) == len(span.replace(" ", "")))
    if kind == 2 and len(digits) == 9:
        return int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    if kind == 2:
        return int(any(a <= int(digits[:4]) <= b and len(digits) in n for a, b, n in _ISSUERS))
    if span[0] == "+" or digits[:2] == "00":
        return int(not digits.removeprefix("00").startswith(_NO_ZONE))
    return int(digits[0] > "1")


def _votes(text: str, start: int, kind: int, end: int, regex: int) -> tuple[int, int, int, int, int]:
    """(kind, regex labeler, gazetteer, context, shape): votes are 1 for, 0 against, 2 for none."""
    before = text[max(0, start - _CUE_WIDTH) : start].lower()
    spoken = [k for k, cues in enumerate(_CUES.values()) if any(c in before for c in cues)]
    context = FOR if kind in spoken else AGAINST if spoken or any(c in before for c in _AGAINST) else NONE
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = (1 if left.isalnum() or right.isalnum() else 0) + 2 * min(3, (end - start) // 10)
    return kind, regex, _registered(kind, text[start : min(end, start + 200)]), context, shape


def _apart(spans: list[tuple], covered: list[tuple[int, int]]) -> list[tuple]:
    """Of ``spans`` (start, kind, end, ..), sorted, those that touch none of the sorted disjoint ``covered`` and none kept before."""
    starts, out, last = [s for s, _ in covered], [], 0
    for x in spans:
        i = bisect_right(starts, x[0])
        if x[0] >= last and (not i or covered[i - 1][1] <= x[0]) and (i == len(covered) or covered[i][0] >= x[2]):
            out.append(x)
            last = x[2]
    return out


def _union(spans: list[tuple]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e, *_ in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def candidates(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(start, kind, end, regex vote, base): base spans, wider matches that touch none of them, and failed forms that touch neither."""
    base, failed = _matches(text)
    wide = _apart(_wide(text), _union(base))
    failed = _apart(failed, _union([*base, *wide])) if failed else failed
    return sorted([*((*x, FOR, True) for x in base), *((*x, False) for x in wide), *((*x, AGAINST, False) for x in failed)])


def _pattern_counts(batches):
    from collections import Counter

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("_text").to_pylist():
            for start, kind, end, regex, _ in candidates(text):
                seen[_votes(text, start, kind, end, regex)] += 1
    rows = list(seen.items())
    yield pa.RecordBatch.from_arrays(
        [*[pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(5)], pa.array([n for _, n in rows], pa.int64())], names=["kind", "regex", "gazetteer", "context", "shape", "n"]
    )


def fit(counts: list[tuple], rounds: int = ROUNDS) -> dict:
    """The span classifier from (kind, regex, gazetteer, context, shape, n) rows: log odds per kind and feature value.

    Expectation-maximisation gives, per kind, the share of true spans and each labeler's rates of voting for true and
    for false spans, over the spans that it votes on; weak priors keep the two classes from changing places.  The
    classifier's features are then counted under the posteriors, shape included."""
    model: dict = {}
    for kind in range(len(KINDS)):
        rows = [r for r in counts if r[0] == kind]
        if not rows:
            continue
        share = 0.7
        rate = [[0.8, 0.3] for _ in range(LABELERS)]  # of a vote for, if true and if false
        post: list[float] = []
        for _ in range(rounds):
            was, post = post, []
            for r in rows:
                yes, no = math.log(share), math.log(1 - share)
                for j in range(LABELERS):
                    v = r[1 + j]
                    if v != NONE:
                        yes += math.log(rate[j][0] if v else 1 - rate[j][0])
                        no += math.log(rate[j][1] if v else 1 - rate[j][1])
                post.append(1 / (1 + math.exp(min(500, no - yes))))
            total = sum(r[5] for r in rows)
            share = min(0.999, max(0.001, (sum(p * r[5] for p, r in zip(post, rows)) + 1) / (total + 2)))
            for j in range(LABELERS):
                for c in (0, 1):
                    w = [(p if c == 0 else 1 - p) * r[5] for p, r in zip(post, rows)]
                    cast = sum(x for x, r in zip(w, rows) if r[1 + j] != NONE)
                    hit = sum(x for x, r in zip(w, rows) if r[1 + j] == FOR)
                    prior = 4 * (0.75 if c == 0 else 0.35)
                    rate[j][c] = min(0.999, max(0.001, (hit + prior) / (cast + 4)))
            if was and max(abs(p - q) for p, q in zip(was, post)) < 1e-9:
                break
        odds: dict = {"prior": math.log(share / (1 - share)), "share": share, "rates": rate}
        all_yes, all_no = (sum(x) + 1 for x in zip(*((p * r[5], (1 - p) * r[5]) for p, r in zip(post, rows))))
        for f in range(FEATURES):
            for value in {r[1 + f] for r in rows}:
                yes = sum(p * r[5] for p, r in zip(post, rows) if r[1 + f] == value) + 0.5
                no = sum((1 - p) * r[5] for p, r in zip(post, rows) if r[1 + f] == value) + 0.5
                odds[f, value] = math.log(yes / all_yes) - math.log(no / all_no)
        model[kind] = odds
    return model


def _pattern_table(docs: DataFrame, text: str) -> list[tuple]:
    """Counts of vote patterns over the whole corpus: at most a few hundred rows, whatever the corpus."""
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    seen = src.mapInArrow(_pattern_counts, "kind int, regex int, gazetteer int, context int, shape int, n bigint")
    return sorted(tuple(r) for r in seen.groupBy("kind", "regex", "gazetteer", "context", "shape").agg(F.sum("n").alias("n")).collect())


def train(docs: DataFrame, text: str = "text") -> dict:
    return fit(_pattern_table(docs, text))


def decide(text: str, model: dict) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base): base spans and the candidates that the classifier accepts; what failed its form's test only served the estimation."""
    out = []
    for start, kind, end, regex, base in candidates(text):
        if regex == AGAINST:
            continue
        if not base:
            odds = model.get(kind)
            if odds is None:
                continue
            v = _votes(text, start, kind, end, regex)
            # As in the estimation, an abstention says nothing.
            if odds["prior"] + sum(odds.get((f, v[1 + f]), 0.0) for f in range(FEATURES) if f >= LABELERS or v[1 + f] != NONE) < 0:
                continue
        out.append((start, kind, end, base))
    return out


def _finder(model: dict, masks: bool):
    def join(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def run(batches):
        for batch in batches:
            counts, base_digest, spans, masked = [[] for _ in KINDS], [], [], []
            for text in batch.column("_text").to_pylist():
                found = decide(text, model)
                base = [x[:3] for x in found if x[3]]
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                base_digest.append(hashlib.sha256(join(base).encode()).hexdigest())
                spans.append(join(x[:3] for x in found))
                if masks:
                    parts, at = [], 0
                    for s, k, e, _ in found:
                        if e > at:
                            parts += [text[at : max(at, s)], f"[{KINDS[k].upper()}]"]
                            at = e
                    masked.append("".join([*parts, text[at:]]))
            rest = batch.drop_columns(["_text"])
            cols = [*rest.columns, *[pa.array(c, pa.int64()) for c in counts], pa.array(base_digest, pa.string()), pa.array(spans, pa.string())]
            names = [*rest.schema.names, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            if masks:
                cols.append(pa.array(masked, pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def find(docs: DataFrame, keep: list[str] | None = None, text: str = "text", masks: bool = False, model: dict | None = None) -> DataFrame:
    """Per row of ``docs``: the columns ``keep`` (doc_id by default), n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), and with ``masks`` the text with every span replaced by its kind.

    Positions are code points.  Null and empty texts have no spans; repeated rows and null ids each get a row; an
    empty table trains an empty model and gives no rows.  Two passes over the texts, no shuffle of them."""
    keep = keep or ["doc_id"]
    model = train(docs, text) if model is None else model
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")
    more = ", ".join(f"n_{k} bigint" for k in KINDS)
    return src.mapInArrow(_finder(model, masks), f"{kinds}, {more}, base_sha256 string, spans string" + ", masked string" * masks)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; a null text stays null, other columns stay."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name can clash
    at = f"c{names.index(text)}"
    got = find(plain.withColumn("none", F.col(at).isNull()), [*[c for c in plain.columns if c != at], "none"], at, masks=True)
    return got.select(*[(F.when(~F.col("none"), F.col("masked")) if c == at else F.col(c)).alias(n) for c, n in zip(plain.columns, names)])
