r"""PII: rule spans, and candidates that gradient-boosted trees accept.

The base spans are e-mail addresses, IPv4 addresses, card numbers that pass Luhn and international phone
numbers, found by fixed patterns, leftmost and non-overlapping per kind; they always stay.  Beside them
generators of high recall propose further, overlapping spans: addresses written with "at" and "dot", IPv6
and masked IPv4, cards in other groupings, numbers without a plus, and three kinds that have no base
pattern: secrets (keys, tokens, passwords), IBANs and social security numbers.  Boosted trees score each
from its format (check digits, groups, mix of signs) and the words around it, and what reaches the
threshold of its kind is added.

The trees are trained here, per corpus, on spans planted into its own texts: of at most ``SAMPLE``
documents (those whose hash of doc_id is below a bound) up to ``PLACES`` places each give the surroundings, and a
seeded rule writes a true form or a look-alike (dates, versions, sums, order numbers, digits that fail
their check) there.  Documents are dealt into three parts by the hash of their id: trees are fitted on
the first, the second calibrates the scores and sets, per kind, the least threshold of 0.5 or more at
which at least ``PRECISION`` of what is accepted is right, and ``held_out`` measures on the third.

Every text is searched whole, row by row; no rows are shuffled, and the searches take time in proportion
to the text.  What training brings to the driver is bounded by SAMPLE * PLACES snippets.

Defined results: a null text is empty; repeated rows give equal rows; an empty table gives no rows; a
corpus without any text is trained on made words; other columns are not read by ``find_pii`` and are kept
by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .boosting import BoostedTrees, platt
from .common import map_batches, table, texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the trees find.
ADDED = ("secret", "iban", "ssn")
ORDER = {kind: k for k, kind in enumerate(KINDS + ADDED)}
#: Documents and places of each that training sees at most; characters around a place; the least number of planted spans.
SAMPLE, PLACES, AROUND, PLANTED = 2_000, 4, 80, 6_000
SEED, PRECISION = 11, 0.99

# Fixed patterns of the base spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# What proposes further spans.
NUMBERS = re.compile(r"(?<![\w+])[(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,19}(?![\w])")
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[\[({<]at[\])}>]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({<]dot[\])}>]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}", re.I)
#: What every match of WRITTEN holds, in lower case.
AT = re.compile(r"@|[\[({<]at[\])}>]|\x20at\x20")
DIGIT = re.compile("[0-9]")
COLONS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
MASKED = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![\w.])")
#: Strings long enough for a key, and what is assigned to a name that speaks of one; neither has an upper length.
OPAQUE = re.compile(r"(?<![\w/+.-])[A-Za-z0-9_+/.-]{16,}(?![\w/+-])")
NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|credential|api[_-]?key|access[_-]?key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?([^\s\"',;<>]{6,})", re.I)
NAMES = ("token", "secret", "passw", "pwd", "credential", "key")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![\w-])")

CUES = (
    ("email", "mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "payment"), ("phone", "call", "tel", "fax", "mobile"),
    ("token", "secret", "password", "key", "login"), ("iban", "account", "bank", "transfer"), ("ssn", "social", "security", "insurance"),
    ("version", "release", "section"), ("isbn", "order", "invoice", "serial"), ("date", "on", "since", "until"), ("total", "sum", "usd", "eur"), ("commit", "build", "file", "sha"),
)
CONTEXT = 28


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def mod97(iban: str) -> bool:
    bare = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans; one place may be proposed as several kinds."""
    found, low = [], text.lower()
    if AT.search(low):
        found += [("email", *m.span()) for m in WRITTEN.finditer(text)]
    if ":" in text:
        found += [("ip", *m.span()) for m in COLONS.finditer(text)]
    opaque = {m.span(1) for m in NAMED.finditer(text)} if any(name in low for name in NAMES) else set()
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            found += [("card", *m.span())] * (13 <= n <= 19) + [("phone", *m.span())] * (7 <= n <= 15)
        if "[" in text or "(" in text:
            found += [("ip", *m.span()) for m in MASKED.finditer(text)]
        found += [("ssn", *m.span()) for m in SSN.finditer(text)]
        found += [("iban", *m.span()) for m in IBAN.finditer(text)]
        opaque |= {m.span() for m in OPAQUE.finditer(text) if not m[0].isalpha() and not m[0].isdigit()}
    return found + [("secret", *span) for span in sorted(opaque)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    words = re.findall(r"[a-z]+", before)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    digits = "".join(filter(str.isdigit, span))
    count = span.count
    letters = [c for c in span if c.isalpha()]
    return [
        *(kind == k for k in ORDER), len(span), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        count(" "), count("-"), count("."), count("/"), count("("), count(":"), luhn(digits) if digits else 0, kind == "iban" and mod97(span), span.startswith("0"), span.startswith("("),
        "::" in span, bool(re.search("[a-f]", span)), count("@"), "dot" in span.lower(), bool(re.search(r"[\[({<](at|dot)", span, re.I)), count("[.]") + count("(.)"),
        len(set(digits)), len(set(span)) / len(span), len(letters), any(c.isupper() for c in letters), any(c.islower() for c in letters), span.isalpha() and span.islower(), all(c in "0123456789abcdefABCDEF" for c in span),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])), span[:3].lower() in ("sk-", "ghp", "aki", "xox", "eyj"), before[-1:] in ("\"", "'"), bool(re.search(r"[:=]\s*[\"']?$", before)),
        before[-1:] in ("$", "€", "#", "v"), before[-1:] == ":", after[:1] in ("%", "$", "€"),
        *(any(w in cue for w in words[-3:]) for cue in CUES),
    ]


def _forms(rng: np.random.Generator) -> tuple[dict[str, Callable[[], str]], list[Callable[[], str]]]:
    """Writers of the true forms by kind, and of look-alikes."""
    draw = lambda signs, k: "".join(signs[i] for i in rng.integers(0, len(signs), k))
    digit = lambda k: draw("0123456789", k)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda a, b: int(rng.integers(a, b))
    word = lambda: "".join(pick("the", "an", "er", "tion", "re", "ou", "le", "en", "is", "ma", "jo", "sch") for _ in range(number(1, 4)))
    low, alnum, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"

    def card(valid: bool = True) -> str:
        head = pick("4", "51", "37", "6011", "35", "2221") + digit(9 + number(0, 4))
        whole = pick(*(head + c for c in "0123456789" if luhn(head + c) == valid))
        sep = pick("", " ", "-", ".", "/", "  ") if valid else pick("", "", "", " ", "-")
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digit(2)} {digit(4)} {digit(4)}", f"0{digit(3)}/{digit(6)}", f"00{digit(2)} {digit(3)} {digit(7)}", f"{a} {b} {c}")

    def email() -> str:
        at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", "."), ("{at}", "{dot}"))
        return f"{word()}{pick('', '.', '_')}{word()}{pick('', digit(2))}{at}{word()}{dot}{pick('com', 'org', 'net', f'example{dot}com')}"

    def ip() -> str:
        parts = [str(pick(number(0, 256), number(0, 256), number(0, 20))) for _ in range(4)]
        return pick(":".join(draw(hexa, number(2, 5)) for _ in range(8)), f"fe80::{draw(hexa, 4)}:{draw(hexa, 4)}", f"2001:db8:{draw(hexa, 4)}::{draw(hexa, 3)}", pick("[.]", "(.)", "[dot]", "(dot)").join(parts))

    def long_or_short(least: int) -> int:
        """Mostly short, up to about 5,000."""
        return pick(number(least, 48), number(least, 48), int(least * 2 ** (8 * rng.random())))

    def secret() -> str:
        long = pick(draw(hexa, pick(32, 40, 64, 128, 512)), draw(alnum, long_or_short(20)), draw(alnum + "+/", long_or_short(20)))
        name = pick("token", "secret", "api_key", "password", "access_key", "credential")
        quote = pick("", '"', "'")
        named = f"{name}{pick(' = ', '=', ': ')}{quote}{pick(long, long, draw(alnum, number(8, 16)) + pick('!', '#', '9'))}{quote}"
        return pick(named, named, f"sk-{draw(alnum, long_or_short(20))}", f"AKIA{draw(alnum[:26] + '0123456789', 16)}", f"ghp_{draw(alnum, 36)}", f"xoxb-{digit(12)}-{draw(alnum, 24)}", f"eyJ{draw(alnum, 20)}.eyJ{draw(alnum, long_or_short(20))}.{draw(alnum + '-_', pick(43, 86, 342))}")

    def iban(valid: bool = True) -> str:
        land, own = pick("DE", "FR", "ES", "GB", "NL"), pick(digit(18), draw(alnum[:26], 4) + digit(14))
        rest = 98 - int("".join(str(int(c, 36)) for c in own + land + "00")) % 97
        whole = f"{land}{(rest if valid else (rest + number(1, 90)) % 97):02}{own}"
        return pick("", " ").join(whole[i : i + 4] for i in range(0, len(whole), 4))

    ssn = lambda: f"{number(1, 900):03}{(sep := pick('-', '-', ' '))}{number(1, 100):02}{sep}{number(1, 10000):04}"
    year = lambda: number(1900, 2100)
    other = [
        lambda: f"{year()}-{number(1, 13):02}-{number(1, 29):02}", lambda: f"{number(1, 29):02}.{number(1, 13):02}.{year()}", lambda: f"{number(1, 13):02}/{number(1, 29):02}/{year()}", lambda: f"{year()} - {year()}",
        lambda: f"{year()}-{number(1, 13):02}-{number(1, 29):02} {number(0, 24):02}:{number(0, 60):02}:{number(0, 60):02}", lambda: ".".join(str(number(0, 99)) for _ in range(5)), lambda: digit(number(7, 20)),
        lambda: f"97{pick('8', '9')}-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", lambda: f"{digit(3)} {digit(3)} {digit(3)}", lambda: f"{digit(2)}:{digit(2)}:{digit(2)}", lambda: f"{word()} at {word()}.{word()}",
        lambda: " ".join(digit(1) for _ in range(number(7, 12))), lambda: card(False), lambda: card(False), lambda: f"{word()} @ {word()}. {word()}", lambda: " ".join(str(number(10, 99)) for _ in range(number(4, 8))),
        lambda: iban(False), lambda: f"{pick('commit', 'sha', 'build')} {draw(hexa, 40)}", lambda: f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", lambda: f"{word()}-{word()}-{word()}-{number(1, 99)}.{word()}",
        lambda: f"{word()}/{word()}/{word()}_{number(1, 99)}.txt", lambda: "/".join(word() for _ in range(long_or_short(4))), lambda: "-".join(word() for _ in range(long_or_short(4))) + digit(2), lambda: f"{pick('token', 'password', 'secret', 'key')}{pick(': ', ' = ')}{pick(word() + word() + low[number(0, 26)], 'required', 'forgotten', 'optional')}", lambda: f"{pick('order', 'invoice')} {digit(3)}-{digit(2)}-{digit(4)}",
        lambda: f"{pick('token', 'password', 'secret')}{pick(': ', ' = ', '=')}{draw(low, number(6, 12))}", lambda: f"{number(1, 99)},{digit(3)},{digit(3)}.{digit(2)}", lambda: f"{word()}_{word()}_{word()}_{digit(4)}",
    ]
    return {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret, "iban": iban, "ssn": ssn}, other


def planted(places: list[tuple[int, str, str]], n: int = PLANTED, seed: int = SEED) -> tuple[list[str], list[tuple[str | None, int, int]], np.ndarray]:
    """Texts with one written form each, its (kind, start, end) (None: a look-alike), and the part of its document.

    ``places``: (part, text before, text behind), used in turn until ``n`` are written.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    real, other = _forms(rng)
    made, spans, parts = [], [], []
    kinds = tuple(real)
    for k in range(max(n, len(places))):
        part, before, behind = places[k % len(places)]
        kind = pick(*kinds, *(None,) * len(kinds))
        form = real[kind]() if kind else pick(*other)()
        cues = CUES[kinds.index(kind)] if kind else pick(*CUES[len(kinds) :])
        lead = f"{pick(*cues)}{pick(' ', ': ', ' is ')}" if rng.random() < 0.6 else pick("", f"{pick(*sum(CUES, ()))} ")
        if kind == "ssn" and rng.random() < 0.8:
            lead = f"{pick('SSN', 'social security', 'my ssn')}{pick(' ', ': ', ' is ')}"
        head = f"{before} {lead}"
        made.append(f"{head}{form} {behind}")
        spans.append((kind, len(head), len(head) + len(form)))
        parts.append(part)
    return made, spans, np.array(parts)


@dataclass
class Detector:
    """Trees, scale and shift of the calibration, the threshold of each kind, and on the held-out part the precision of what is added and the recall with base spans."""

    trees: BoostedTrees
    scale: float
    shift: float
    thresholds: dict[str, float]
    held_out: dict[str, tuple[float, float]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.trees.score(x) + self.shift, -50, 50)))


def fit(places: list[tuple[int, str, str]], n: int = PLANTED, seed: int = SEED) -> Detector:
    """Parts 0 to 2 of ``places`` are fitted on, 3 calibrates, 4 is held out."""
    rows, right, kinds, of, own_parts = [], [], [], [], []
    made, spans, parts = planted(places, n, seed)
    for k, (text, (kind, start, end)) in enumerate(zip(made, spans)):
        for c in candidates(text):
            if c[1] < end and start < c[2]:  # what the surroundings hold has no label
                rows.append(features(text, *c))
                right.append(c[0] == kind)
                kinds.append(c[0])
                of.append(k)
                own_parts.append(parts[k])
    x, y, kinds, of, part = np.array(rows, float), np.array(right, float), np.array(kinds), np.array(of), np.array(own_parts)
    trees = BoostedTrees(trees=120, depth=4).fit(x[part < 3], y[part < 3])
    scale, shift = platt(trees.score(x[part == 3]), y[part == 3])
    found = Detector(trees, scale, shift, {}, {})
    p = found.probability(x)
    wanted = np.array([kind or "" for kind, _, _ in spans])
    for kind in ORDER:
        own = (kinds == kind) & (part == 3)
        order = np.argsort(-p[own], kind="stable")
        precision = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(precision >= PRECISION)
        found.thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
        taken = (kinds == kind) & (part == 4) & (p >= found.thresholds[kind])
        asked = np.flatnonzero((wanted == kind) & (parts == 4)).tolist()
        by_rule = {k for k in asked if any(b[0] == kind and b[1] < spans[k][2] and spans[k][1] < b[2] for b in base_spans(made[k]))}
        hit = by_rule | set(of[taken & (y > 0)].tolist())
        found.held_out[kind] = (float(y[taken].mean()) if taken.any() else 1.0, len(hit) / len(asked) if asked else 1.0)
    return found


def places_of(docs: DataFrame, sample: int = SAMPLE, places: int = PLACES) -> list[tuple[int, str, str]]:
    """(part, text before, text behind) of up to ``places`` places in each of about ``sample`` documents, ``sample * places`` at most.

    A document is in if the hash of its id is below a bound that follows the number of rows, so one scan finds and cuts them.
    """
    share = min(1.0, sample / max(1, docs.count()))
    chosen = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") < int(share * 2**32)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(chosen)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                seed = zlib.crc32(str(doc_id).encode())
                spaces = [m.start() for m in re.finditer(" ", text)]
                for k in range(min(places, len(spaces))):
                    at = spaces[(seed + k * len(spaces) // places) % len(spaces)]
                    out.append((doc_id, k, seed % 5, text[max(0, at - AROUND) : at], text[at + 1 : at + 1 + AROUND]))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "k", "part", "before", "behind"])

    found = rows.mapInArrow(cut, "doc_id long, k int, part int, before string, behind string")
    return [(r["part"], r["before"], r["behind"]) for r in found.orderBy("doc_id", "k", "before", "behind").limit(sample * places).collect()]


def train(docs: DataFrame, sample: int = SAMPLE) -> Detector:
    """Fitted on spans planted into ``docs``; a part of the five that has no place gets made ones."""
    places = places_of(docs, sample)
    short = {*range(5)} - {part for part, _, _ in places}
    return fit(places + [(part, f"lorem ipsum {k}", "dolor sit amet") for part in sorted(short) for k in range(max(1, len(places) // 5))])


def all_spans(batch: list[str], model: Detector) -> list[tuple[list, list]]:
    """For each text: base spans, added spans."""
    base = [base_spans(t) for t in batch]
    proposed = [(k, c) for k, t in enumerate(batch) for c in candidates(t)]
    added: list[list] = [[] for _ in batch]
    if proposed:
        p = model.probability(np.array([features(batch[k], *c) for k, c in proposed], float))
        taken = [{kind: ([s for q, s, _ in own if q == kind], [e for q, _, e in own if q == kind]) for kind in ORDER} for own in base]
        for q in np.argsort(-p, kind="stable"):
            k, (kind, start, end) = proposed[q]
            if p[q] < model.thresholds[kind]:
                continue
            starts, ends = taken[k][kind]
            at = bisect_left(starts, end)  # spans of one kind stay apart
            if at and ends[at - 1] > start:
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            added[k].append((kind, start, end))
    return [(b, sorted(x, key=lambda s: (ORDER[s[0]], s[1]))) for b, x in zip(base, added)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (ORDER[x[0]], x[1])))


def find_pii(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.  Without ``detector`` one is trained on ``docs``."""
    model = detector or train(docs)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(texts(batch), model)
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        shas = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found])
        spans = pa.array([_joined(base + more) for base, more in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, spans, pa.array([len(m) for _, m in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the mark of its first kind."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start < done:
            done = max(done, end)
            continue
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` replaced; ``n_chars``, if there, follows."""
    model, names = detector or train(docs), docs.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        spans = all_spans([t or "" for t in old], model)
        new = [t if t is None else redacted(t, base + more) for t, (base, more) in zip(old, spans)]
        columns = {"text": pa.array(new, pa.string()), "n_chars": pa.array([len(t or "") for t in new], pa.int64())}
        return pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in names], names)

    ready = docs.withColumn("n_chars", F.col("n_chars").cast("long")) if "n_chars" in names else docs
    return ready.mapInArrow(lambda batches: map(rows, batches), ready.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
SQL: dict[str, str] = {}
