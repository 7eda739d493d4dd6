"""Personal data: fixed patterns, and candidates judged by gradient-boosted trees.

Four fixed patterns always count. Beside them, generators with high recall propose
overlapping spans: e-mail addresses spelled out or spaced, telephone numbers without a
plus, IPv6 addresses, card numbers with unusual separators, bank account and social
security numbers, and long runs of letters and digits that may be keys. Boosted trees score each candidate by its format and its context, the
scores are calibrated on a held-out part, each kind has the lowest threshold that keeps
the wanted precision there, and of overlapping candidates the likeliest stays.

There are no labelled spans, so the trees learn from a seeded generator of formats, true
ones and lookalikes (dates, prices, versions, order numbers), among invented words. The
sample has EXAMPLES rows; the model is a few kilobytes.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from utterloom.llm.base import arrow_schema, batch, table, text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")  # in the order of spans with one start
EXAMPLES, SEED, PRECISION = 8000, 11, 0.99
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
NEAR = 32  # characters of context on either side
RESULT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, personal boolean"

# ---- fixed patterns ---------------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of an address, in time linear in the text: the run before each @, then the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1  # no later match holds this @ or what precedes it
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of four numbers with dots between, all at most 255, in time linear in the text: dotted runs, four parts at a time."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in own):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, by start and kind."""
    out = [(s, e, "email") for s, e in emails(text)]
    out += [(s, e, "ip") for s, e in ips(text)]
    for m in CARD.finditer(text):
        number = digits(m.group())
        if 12 <= len(number) <= 19 and luhn(number):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=order)


def order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


# ---- candidates -------------------------------------------------------------

AT, DOT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s?@\s?)", r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\.)"
GENERATORS = (
    ("email", re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}})+", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{4}[ ./_-]{1,2}[0-9]{6}[ ./_-]{1,2}[0-9]{5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:00|\+)?[0-9]{9,13}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{16,256}={0,2}(?![0-9A-Za-z_+/-])")),
)
#: Words that speak for a kind, and words that speak against all; in the context, in lower case.
CUES = (
    ("email", ("mail", "contact", "write to", "reach", "courriel", "correo")),
    ("ip", ("ip", "address", "host", "server", "adresse", "login from")),
    ("card", ("card", "visa", "master", "amex", "karte", "carte", "tarjeta", "credit", "pay")),
    ("phone", ("tel", "phone", "call", "mobile", "cell", "fax", "sms", "whatsapp", "handy", "anruf", "appel", "llam", "contact")),
    ("iban", ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer", "bic")),
    ("ssn", ("ssn", "social", "security", "insurance", "taxpayer", "tax id")),
    ("secret", ("token", "secret", "passw", "pwd", "key", "bearer", "credential", "auth", "clave", "schl", "jeton")),
    ("none", ("isbn", "commit", "sha", "md5", "checksum", "hash", "http", "uuid", "digest", "version", "order", "invoice", "page", "total", "price", "sku", "ref", "serial", "build", "date", "born in", "since", "section", "chapter", "score", "room", "seite", "article", "$", "€", "£", "%", "=")),
)


#: What every match of the e-mail generator holds between its name and its domain, and a character of the name.
SIGN, NAME = re.compile(r"@|(?<=[\s\[({<])at(?=[\s\])}>])", re.I), re.compile(r"[A-Za-z0-9._%+-]", re.I)


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail generator's matches, found from their signs: the name ends at most three characters before one."""
    pattern, free = GENERATORS[0][1], 0
    for sign in SIGN.finditer(text):
        for end in range(max(free + 1, sign.start() - 3), sign.start() + 1):
            if NAME.match(text[end]) or not NAME.match(text[end - 1]):
                continue
            start = end
            while start > max(free, end - 64) and NAME.match(text[start - 1]):
                start -= 1
            while start < end and text[start] in "._%+-":
                start += 1
            if start < end and (m := pattern.match(text, start)):
                yield m.span()
                free = m.end()
                break


def mixed(s: str) -> bool:
    """Whether a run has both letters and digits, and enough of either to be a key."""
    number = len(digits(s))
    return number >= 3 and sum(c.isalpha() for c in s) >= 3


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that a generator proposes, of all kinds, overlapping ones too."""
    out = [(*x, "email") for x in spelled(text)]
    if any(c in text for c in "0123456789"):
        out += [(*m.span(), kind) for kind, pattern in GENERATORS[1:] for m in pattern.finditer(text) if kind != "secret" or mixed(m.group())]
    return out


def iban_rest(s: str) -> int:
    plain = s.replace(" ", "").replace("-", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a candidate as numbers."""
    start, end, kind = span
    s, number = text[start:end], digits(text[start:end])
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR // 2].lower()
    groups = [len(x) for x in re.findall(r"[0-9]+", s)] or [0]
    marks = {c for c in s if not c.isalnum()}
    count = {c: s.count(c) for c in set(s)}
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in count.values())
    cues = [float(any(w in before or w in after for w in words)) for _, words in CUES]
    own = [c for (k, _), c in zip(CUES, cues) if k == kind][0]
    year = float(any(1900 <= int(x) <= 2100 for x in re.findall(r"(?<![0-9])[0-9]{4}(?![0-9])", s)))
    last = before[-1:] or "\n"
    return [
        float(KINDS.index(kind)), len(s), len(number), len(groups), groups[0], groups[-1], max(groups), min(groups), len(marks), entropy,
        sum(c.isupper() for c in s), sum(c.isalpha() for c in s), float(s.startswith(("+", "00", "0"))), float("(" in s), float("/" in s), float("." in s), float(":" in s), float("-" in s),
        float(len(number) >= 12 and luhn(number)), float(kind == "iban" and iban_rest(s) == 1), float(kind == "email" and bool(re.search(r"(?:\.|dot\W{0,2})\s?[a-z]{2,6}$", s, re.I))),
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) / len(s), float(before.rstrip(" \"'")[-1:] in (":", "=")), len(number) / len(s), year, len(set(number)), float(last.isdigit() or last in ".,-/#$€£:="), float(after[:1] in "%°$€£/" and bool(after)), own, *cues,
    ]


# ---- boosted trees ----------------------------------------------------------


class Boosted:
    """Trees of fixed depth for the logistic loss, grown on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins, f = self.binned(x), np.full(len(y), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        self.base, self.trees = float(f[0]), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self.grow(bins, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][self.leaf(tree, bins)]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], 1)

    @staticmethod
    def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, feature, cut = np.zeros(len(g), np.int64), np.zeros(2**DEPTH - 1, np.int64), np.zeros(2**DEPTH - 1, np.int64)
        for at in range(2**DEPTH - 1):
            own, best = node == at, 1e-6
            feature[at], cut[at] = 0, BINS + 1  # all to the left
            if own.any():
                for j in range(bins.shape[1]):
                    sg, sh = (np.cumsum(np.bincount(bins[own, j], w[own], BINS)) for w in (g, h))
                    left, right = sg[:-1] ** 2 / (sh[:-1] + 1), (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1)
                    gain = left + right - sg[-1] ** 2 / (sh[-1] + 1)
                    if gain.max() > best:
                        best, feature[at], cut[at] = gain.max(), j, int(gain.argmax()) + 1
            node[own] = 2 * at + 1 + (bins[own, feature[at]] >= cut[at])
        leaf, n = node - (2**DEPTH - 1), 2**DEPTH
        return feature, cut, RATE * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)

    @staticmethod
    def leaf(tree: tuple, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, tree[0][at]] >= tree[1][at])
        return at - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + sum(t[2][self.leaf(t, bins)] for t in self.trees)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic fit of labels to a * margin + b, by Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, w = y - p, p * (1 - p) + 1e-6
        hessian = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(r * margin).sum() - 1e-3 * (a - 1), r.sum() - 1e-3 * b])
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


# ---- examples ---------------------------------------------------------------


def example(rng: random.Random) -> tuple[str, str, int, int, bool]:
    """(text, kind or empty, start, end, whether it is personal data)."""
    pick, n = rng.choice, lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick(("an", "the", "ou", "ti", "er", "en", "re", "sh", "ion", "ble", "de", "la", "que", "ver", "ch", "ung")) for _ in range(rng.randint(1, 4)))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    true = rng.random() < 0.5
    kind = pick(KINDS)
    sep = pick((" ", "-", ".", "/"))
    if true:
        if kind == "email":
            left, right = pick(("()", "[]", "{}", "<>"))
            wide = lambda w: pick((left + w + right, f" {left}{w}{right} ", f" {left} {w} {right} "))
            at = pick((" at ", "\nat\n", " @ ", "@ ", wide("at"), wide("at"), wide("at")))
            dot = pick((" dot ", "\ndot\n", wide("dot"), wide("dot"), "."))
            s = word() + pick(("", ".", "_")) + pick((word(), n(2))) + at + word() + dot + pick(("com", "org", "net", "de", "fr", "es", "example" + dot + "com"))
        elif kind == "ip":
            h = lambda: f"{rng.randrange(1, 65536):x}"
            s = pick((":".join(h() for _ in range(8)), f"2001:db8::{h()}", f"fe80::{h()}:{h()}:{h()}:{h()}", f"2001:{h()}:{h()}::{h()}"))
        elif kind == "card":
            body = pick(("4", "51", "52", "55", "37", "6011", "34"))
            size = 15 if body[0] == "3" else 16
            body += n(size - 1 - len(body))
            s = next(body + c for c in "0123456789" if luhn(body + c))
            parts = (4, 6, 5) if size == 15 else (4, 4, 4, 4)
            sep = pick((".", "/", "  ", " - ", "_", "--"))[:2]
            s = sep.join(s[sum(parts[:i]) : sum(parts[: i + 1])] for i in range(len(parts)))
        elif kind == "phone":
            s = pick((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)}{sep}{n(6)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"0{n(4)}/{n(5)}", f"6{n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(9)}"))
        elif kind == "iban":
            land, size = pick((("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)))
            body = ("".join(pick("ABCDEFGHIJ") for _ in range(4)) if land in ("GB", "NL") else "") + n(size)
            body = body[:size]
            s = f"{land}{98 - iban_rest(land + '00' + body) :02d}{body}"
            s = pick((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))
        elif kind == "secret":
            body = pick(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
            s = pick(("", "", "", "sk_live_", "ghp_", "AKIA", "xoxb-")) + "".join(pick(body) for _ in range(rng.randint(20, 64)))
        else:
            s = f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        cue = pick([w for k, words in CUES if k == kind for w in words] + [word()])
    else:
        year = str(rng.randint(1900, 2100))
        s = pick((
            f"{rng.randint(1, 28):02d}{sep}{rng.randint(1, 12):02d}{sep}{year}", f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{year}-{int(year) + 5}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(1)}.{n(2)}.{n(3)}",
            f"{n(2)}.{n(3)}.{n(3)}", f"{n(9)}", f"{n(12)}", f"{n(10)}", f"{n(16)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(3)} {n(3)} {n(3)}", f"{n(2)}-{n(2)}", f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(3)} {n(2)} {n(4)}",
            f"{n(4)}/{n(2)}", f"{n(2)}.{n(2)}", f"{n(5)}-{n(4)}", f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"ab:cd:{n(2)}", f"{''.join(pick('ABCDEFGH0123') for _ in range(16))}", f"XX{n(2)} {n(4)} {n(4)} {n(3)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}.{n(3)}",
            word() + "-" + word() + "-" + word() + "-" + n(4), word() + "_" + word() + n(3) + "_" + word(), f"{word()}/{n(4)}/{n(2)}/{word()}-{word()}", word() * 3 + n(3), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", hexes(40),
        ))
        cue = pick([*CUES[-1][1], *[word() for _ in range(20)]])
        if re.fullmatch("[0-9a-f]{40}", s):
            cue = pick(("commit", "sha", "checksum", "hash", "digest"))
    left = " ".join(word() for _ in range(rng.randint(0, 6)))
    hard = true and kind == "secret" or not true and re.fullmatch("[0-9a-f]{40}", s)  # told by the cue alone
    lead = f"{left} {cue}" + pick((" ", ": ", " is ", " ", " ") if not hard else (" = ", ": ", "=", " ", ' = "', ": '"))
    lead = lead if hard or rng.random() < 0.7 else left + " "
    return lead + s + pick((" ", ". ", ", ", "\n", "")) + " ".join(word() for _ in range(rng.randint(0, 5))), kind if true else "", len(lead), len(lead) + len(s), true


@functools.cache
def model(examples: int = EXAMPLES, seed: int = SEED) -> tuple[Boosted, tuple[float, float], dict[str, float]]:
    """Trees, calibration, and each kind's threshold. Three quarters of the examples grow the trees, the others calibrate."""
    rng, rows, labels, kinds = random.Random(seed), [], [], []
    for _ in range(examples):
        text, kind, start, end, true = example(rng)
        for c in candidates(text):
            hit = true and c[2] == kind and min(end, c[1]) - max(start, c[0]) >= 0.8 * (max(end, c[1]) - min(start, c[0]))
            if hit or c[1] <= start or c[0] >= end or not true or c[2] != kind:
                rows.append(features(text, c))
                labels.append(float(hit))
                kinds.append(c[2])
    x, y, kinds = np.array(rows), np.array(labels), np.array(kinds)
    held = np.arange(len(y)) % 4 == 3
    trees = Boosted(x[~held], y[~held])
    margin = trees.margin(x[held])
    a, b = calibrate(margin, y[held])
    p, limits = 1 / (1 + np.exp(-(a * margin + b))), {}
    for k in KINDS:
        own = np.flatnonzero(kinds[held] == k)
        own = own[np.argsort(-p[own], kind="stable")]
        right = np.cumsum(y[held][own]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[k] = max(0.5, float(p[own][good[-1]])) if len(good) else 1.01
    return trees, (a, b), limits


class Taken:
    """Disjoint stretches of a text, in order; asked and added to by bisection."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for s, e, _ in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def found(text: str, judge: tuple) -> tuple[list, list]:
    """Base spans, and all spans: base ones and chosen candidates that overlap neither them nor each other."""
    base = base_spans(text)
    trees, (a, b), limits = judge
    taken = Taken(base)
    free = [c for c in candidates(text) if taken.free(c[0], c[1])]
    if not free:
        return base, base
    p = 1 / (1 + np.exp(-(a * trees.margin(np.array([features(text, c) for c in free])) + b)))
    chosen: list[tuple[int, int, str]] = []
    for i in np.argsort(-p, kind="stable"):
        c = free[i]
        if p[i] >= limits[c[2]] and taken.free(c[0], c[1]):
            chosen.append(c)
            taken.add(c[0], c[1])
    return base, sorted(base + chosen, key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span as its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """doc_id, counts of the fixed patterns, their digest, all spans, their number and whether there are any; with redact also the redacted text.

    Positions are code points, ends exclusive. Null texts are empty and have no spans;
    repeated rows are judged alike. No rows give no rows.
    """
    text_batches(docs.sparkSession)
    judge, kind = model(), dict(docs.dtypes)["doc_id"]
    result = RESULT + ", redacted string" * redact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                base, spans = found(text or "", judge)
                counts = [sum(k == x for _, _, x in base) for k in KINDS[:4]]
                rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans), bool(spans), *([redacted(text or "", spans)] * redact)))
            yield batch(rows, pa.schema([b.schema.field("doc_id"), *arrow_schema(result.replace(", ", ","))]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {result}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
