"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans. The field then labels the tokens of a document jointly: neighbours share a chain
potential, distant tokens that are equal or similar share a skip potential, and loopy message passing carries what
is known of one place (a number that a pattern has found) to the others. Tokens that it labels and no base span
covers become further spans; base spans always stay.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from functools import cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = "pii_weights.json"
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---- base spans ------------------------------------------------------------------------------------------------------


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so a long run without one costs nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not any(c in text for c in "0123456789"):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---- the field -------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|]+")
#: What a document without a base span has at least if the field could find something: seven digits in a row of
#: numbers, three dots or hyphens among digits, or an address spelt with "at".
_LIVE = re.compile(r"[0-9](?:[0-9()+./-]*[0-9]){3}|(?i:[(\[]at[)\]])")
_FEATURES = (
    "bias base_email base_ip base_card base_phone at at_word dots4 digits16 digits8 plus digit_part dot_word "
    "case_email".split()
)


def _shape(token: str, base: str | None) -> list[str]:
    """Features of one token."""
    out = ["bias"]
    if base:
        out.append(f"base_{base}")
    digits = len(_digits(token))
    if "@" in token:
        out.append("at")
    if re.search(r"(?i)[(\[]at[)\]]|[a-z0-9]\(at\)[a-z0-9]", token):
        out.append("at_word")
    if token.count(".") >= 3 and re.fullmatch(r"[(]?[0-9]{1,3}(\.[0-9]{1,3}){3}[).]*", token):
        out.append("dots4")
    if 16 <= digits <= 19:
        out.append("digits16")
    elif 8 <= digits <= 15:
        out.append("digits8")
    elif digits:
        out.append("digit_part")
    if token.startswith(("+", "00")) and digits:
        out.append("plus")
    return out


#: How two mentions are alike: the same letters and digits; a part of a phone or card; whole numbers that differ in one
#: digit. Each has a skip weight of its own.
EQUAL, PART, NEAR = range(3)


class Field:
    """Potentials: unary weights of a feature and label, chain weights of two neighbouring labels, and for each way in
    which tokens are alike a skip weight for equal labels."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, np.asarray(skip, float)

    def scores(self, features: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for i, own in enumerate(features):
            for f in own:
                out[i] += self.unary[_FEATURES.index(f)]
        return out


def _messages(
    unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = 400, damp: float = 0.3
) -> np.ndarray:
    """Loopy sum-product in log space over all edges at once: beliefs (tokens x labels), each row summing to one.

    edges: (n, 2) token places; tables: (n, labels, labels) log potentials of first and second.
    """
    n, k = len(edges), unary.shape[1]
    if not n:
        b = unary
    else:
        to = np.concatenate([edges[:, 1], edges[:, 0]])
        frm = np.concatenate([edges[:, 0], edges[:, 1]])
        pot = np.concatenate([tables, tables.transpose(0, 2, 1)])
        m = np.zeros((2 * n, k))
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        for _ in range(rounds):
            b = unary.copy()
            np.add.at(b, to, m)
            x = (b[frm] - m[back])[:, :, None] + pot
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - m).max() < 1e-4:
                m = new
                break
            m = damp * m + (1 - damp) * new
        b = unary.copy()
        np.add.at(b, to, m)
    p = np.exp(b - b.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fold(token: str) -> str:
    """What equal or similar tokens have in common: letters in lower case and digits alone."""
    return re.sub(r"[^a-z0-9@]", "", re.sub(r"(?i)[(\[]at[)\]]", "@", token).lower())


def _but_one(digits: str) -> list[tuple[int, str]]:
    """Keys of which two numbers of a length share one if they differ in one digit."""
    return [(i, digits[:i] + digits[i + 1 :]) for i in range(len(digits))]


def skip_edges(tokens: list[str], reach: int = 2) -> list[tuple[int, int, int]]:
    """(earlier, later, how alike): each token with the nearest earlier ones of the same folded form, and the nearest
    number that differs in one digit: paths through a group, never all pairs."""
    seen: dict[str, list[int]] = defaultdict(list)
    near: dict[tuple[int, str], int] = {}
    out = []
    for i, t in enumerate(tokens):
        f = _fold(t)
        if len(f) < 4:
            continue
        out += [(j, i, EQUAL) for j in seen[f][-reach:]]
        if not seen[f] and len(f) >= WHOLE and f.isdigit() and len(f) <= 19:
            keys = _but_one(f)
            j = max((near[k] for k in keys if k in near), default=None)
            if j is not None:
                out.append((j, i, NEAR))
            near |= dict.fromkeys(keys, i)
        seen[f].append(i)
    return out


#: Digits that a mention of part of a phone or card has at least, other digits before them, and tokens of a run.
PHONE_PART, CARD_PART, OTHER_PREFIX, RUN = 7, 8, 3, 6
#: Digits from which numbers that differ in one are alike.
WHOLE = 10
_NUMBER = re.compile(r"[0-9()+./-]*[0-9][0-9()+./-]*")
_BETWEEN = re.compile(r"[\x20\t\u00a0().-]{1,4}")
_SPELT = re.compile(r"(?i)[\x20\[(]{1,2}at[\x20\])]{1,2}")
_AT = re.compile(r"[\x20\[(]{1,2}(?i:at)[\x20\])]{1,2}")


class Known:
    """The base mentions of a document, found by what is alike to them."""

    def __init__(self, mentions: list[tuple[str, str]]):
        self.equal: dict[str, set[str]] = defaultdict(set)
        self.phones: dict[str, set[str]] = defaultdict(set)
        self.cards: dict[str, set[str]] = defaultdict(set)
        self.near: dict[tuple[int, str], set[str]] = defaultdict(set)
        for kind, mention in mentions:
            self.equal[_fold(mention)].add(kind)
            own = _digits(mention)
            if kind == "phone":
                self.phones[own[-PHONE_PART:]].add(own)
            elif kind == "card":
                self.cards[own[-CARD_PART:]].add(own)
                self.cards[own[:CARD_PART]].add(own)
            if kind in ("phone", "card") and len(own) >= WHOLE:
                for k in _but_one(own):
                    self.near[k].add(kind)

    def links(self, mention: str) -> dict[str, int]:
        """kind -> how a base mention of that kind is alike; the closest way counts."""
        out = dict.fromkeys(self.equal.get(_fold(mention), ()), EQUAL)
        if not _NUMBER.fullmatch(mention.replace(" ", "").replace("\t", "").replace("\u00a0", "")):
            return out
        own = _digits(mention)
        if PHONE_PART <= len(own) <= 15:
            for whole in self.phones.get(own[-PHONE_PART:], ()):
                same = next((n for n, (a, b) in enumerate(zip(own[::-1], whole[::-1])) if a != b), min(len(own), len(whole)))
                # other dialling prefixes begin with 0
                if len(own) == same or len(own) - same <= OTHER_PREFIX and own[0] == "0":
                    out.setdefault("phone", PART)
        if CARD_PART <= len(own) <= 19:
            if any(x.endswith(own) for x in self.cards.get(own[-CARD_PART:], ())) or any(
                x.startswith(own) for x in self.cards.get(own[:CARD_PART], ())
            ):
                out.setdefault("card", PART)
        if WHOLE <= len(own) <= 19:
            for k in _but_one(own):
                for kind in self.near.get(k, ()):
                    out.setdefault(kind, NEAR)
        return out


def runs(text: str, where: list[tuple[int, int]], tokens: list[str], bases: list[str | None]) -> list[tuple[int, int]]:
    """Places of mentions of several tokens outside base spans: numbers in a row, and an address spelt with "at"."""
    out = []
    for i, (a, end) in enumerate(where):
        if bases[i] is not None:
            continue
        if tokens[i] and _NUMBER.fullmatch(tokens[i]):
            for j in range(i + 1, min(i + RUN, len(where))):
                b = where[j]
                if bases[j] is not None or not tokens[j] or not _NUMBER.fullmatch(tokens[j]) or not _BETWEEN.fullmatch(text, end, b[0]):
                    break
                end = b[1]
                out.append((a, end))
        if i + 2 < len(where) and bases[i + 1] is None and bases[i + 2] is None and _AT.fullmatch(text, end, where[i + 2][0]):
            out.append((a, where[i + 2][1]))
    return out


def fitted(seed: int = 5, passes: int = 30, sentences: int = 160) -> Field:
    """The field by gradient ascent of the pseudo-likelihood on generated sentences with known labels."""
    rng = np.random.default_rng(seed)
    unary = np.zeros((len(_FEATURES), len(LABELS)))
    chain, skip = np.zeros((len(LABELS), len(LABELS))), np.zeros(3)
    prepared = []
    for _ in range(sentences):
        tokens, bases, truth = _generated(rng)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for a, b, how in skip_edges(tokens):
            if bases[a] is None and bases[b] is None:
                near[a].append((truth[b], how))
                near[b].append((truth[a], how))
        known = Known([(b, t) for t, b in zip(tokens, bases) if b])
        for i, t in enumerate(tokens):
            if bases[i] is None:  # as in spans(), a base mention speaks twice
                near[i] += [(LABELS.index(k), how) for k, how in known.links(t).items()] * 2
        of = [[_FEATURES.index(f) for f in _shape(t, b)] for t, b in zip(tokens, bases)]
        prepared.append((of, truth, near))
    step = 0.1
    for _ in range(passes):
        for of, truth, near in prepared:
            for i, own in enumerate(of):
                s = unary[own].sum(axis=0)
                if i:
                    s = s + chain[truth[i - 1]]
                if i + 1 < len(truth):
                    s = s + chain[:, truth[i + 1]]
                agree = np.zeros((3, len(LABELS)))
                for label, how in near[i]:
                    agree[how, label] += 1
                s = s + skip @ agree
                p = np.exp(s - s.max())
                d = -p / p.sum()
                d[truth[i]] += 1
                unary[own] += step * (d - 0.01 * unary[own])
                if i:
                    chain[truth[i - 1]] += step * 0.2 * d
                skip += step * 0.2 * (agree @ d)
    return Field(unary, chain, np.maximum(skip, 0))


@cache
def trained() -> Field:
    """The field as fitted() gives it, from the weights beside this module, so that no worker trains."""
    w = json.loads(files(__package__).joinpath(WEIGHTS).read_text(encoding="utf-8"))
    return Field(np.array(w["unary"]), np.array(w["chain"]), np.array(w["skip"]))


def _generated(rng: np.random.Generator) -> tuple[list[str], list[str | None], list[int]]:
    """A sentence of fillers and personal data; some mentions come again in a form that no pattern finds."""
    tokens: list[str] = []
    bases: list[str | None] = []
    truth: list[int] = []

    def word() -> str:
        return "".join(rng.choice(list("abdeginorstu"), rng.integers(2, 8)))

    def add(t: str, base: str | None, label: str) -> None:
        tokens.append(t)
        bases.append(base)
        truth.append(LABELS.index(label))

    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        body = number(15)
        return next(body + str(c) for c in range(10) if _luhn(body + str(c)))

    known: list[tuple[str, str]] = []
    for _ in range(int(rng.integers(12, 28))):
        x = rng.random()
        if x < 0.6:
            add(word() if rng.random() < 0.9 else number(int(rng.integers(1, 8))), None, "other")
        elif x < 0.66:
            t = f"{word()}.{number(2)}@{word()}.example.com"
            add(t, "email", "email")
            known.append((t, "email"))
        elif x < 0.72:
            t = ".".join(str(rng.integers(1, 255)) for _ in range(4))
            add(t, "ip", "ip")
            known.append((t, "ip"))
        elif x < 0.78:
            t = card()
            add(t, "card", "card")
            known.append((t, "card"))
        elif x < 0.84:
            t = f"+1-{number(3)}-555-{number(4)}"
            add(t, "phone", "phone")
            known.append((t, "phone"))
        elif x < 0.88:  # numbers that are nobody's, some of them twice
            t = number(int(rng.choice([8, 10, 11, 16, 16, 17])))
            for _ in range(int(rng.integers(1, 4))):
                add(t, None, "other")
        elif known and rng.random() < 0.2:  # one digit is wrong
            t, label = known[int(rng.integers(len(known)))]
            if label in ("card", "phone"):
                at = [i for i, c in enumerate(t) if c.isdigit()][int(rng.integers(4, 10))]
                t = t[:at] + str((int(t[at]) + int(rng.integers(1, 10))) % 10) + t[at + 1 :]
                t = t.replace("+", "") if label == "phone" else t
                if label != "card" or not _luhn(t):
                    add(t, None, label)
        elif known:
            t, label = known[int(rng.integers(len(known)))]
            if label == "email":
                t = t.replace("@", "(at)")
            elif label == "phone":
                t = re.sub(r"[^0-9]", "", t) if rng.random() < 0.5 else t[-int(rng.choice([8, 12])) :]
            elif label == "card":
                t = ".".join(t[i : i + 4] for i in range(0 if rng.random() < 0.7 else 4, 16, 4))
            else:
                t = t.replace(".", "-")
            add(t, None, label)
    return tokens, bases, truth


def spans(
    text: str | None, threshold: float = 0.8, field: Field | None = None
) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). A mention that no pattern finds becomes a span if the field believes so: by its own
    shape, its neighbours, and the mentions that are alike, base mentions among them, anywhere in the document."""
    if not text:
        return [], []
    base = base_spans(text)
    if not base and not _LIVE.search(text):
        return base, base
    covered = sorted((a, b, k) for k, a, b in base)
    field = field or trained()
    where, tokens, bases = [], [], []
    c = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a + 1 and text[b - 1] in ".)(":
            b -= 1
        while c < len(covered) and covered[c][1] <= a:
            c += 1
        kind, k = None, c
        while kind is None and k < len(covered) and covered[k][0] < b:
            kind = covered[k][2] if a < covered[k][1] else None
            k += 1
        token = text[a:b]
        if kind is None and not any("0" <= ch <= "9" or ch == "@" for ch in token) and "(at" not in token.lower():
            tokens.append("")  # a plain word: its unary score alone labels it "other"
        else:
            tokens.append(token)
        where.append((a, b))
        bases.append(kind)
    live = [i for i, t in enumerate(tokens) if t]
    known = Known([(k, text[a:b]) for a, b, k in covered])
    # of runs, those that are alike to a base mention are nodes; all others say what their tokens say
    found = [(a, b) for a, b in runs(text, where, tokens, bases) if known.links(_joined(text[a:b]))]
    if not found and all(bases[i] is not None for i in live):
        return base, base
    # a base span of many tokens also counts as one mention, in its whole form
    shown = [tokens[i] for i in live] + [text[a:b] for a, b, _ in covered] + [_joined(text[a:b]) for a, b in found]
    kinds = [bases[i] for i in live] + [k for _, _, k in covered] + [None] * len(found)
    unary = field.scores([_shape(t, k) for t, k in zip(shown, kinds)])
    plain = field.chain[0] + field.chain[:, 0]
    for n, i in enumerate(live):  # neighbours that are plain words are known to be "other"
        for j in (i - 1, i + 1):
            if 0 <= j < len(tokens) and not tokens[j]:
                unary[n] += plain / 2
    for n, (t, k) in enumerate(zip(shown, kinds)):
        if k is None:  # the labels of base mentions are known: two of them speak to each mention that is alike
            for kind, how in known.links(t).items():
                unary[n, LABELS.index(kind)] += 2 * field.skip[how]
    edges = [(n, n + 1, field.chain) for n in range(len(live) - 1) if live[n + 1] == live[n] + 1]
    agree = [w * np.eye(len(LABELS)) for w in field.skip]
    edges += [(a, b, agree[how]) for a, b, how in skip_edges(shown) if kinds[a] is None and kinds[b] is None]
    order = np.array([(a, b) for a, b, _ in edges], dtype=int).reshape(-1, 2)
    tables = np.array([t for _, _, t in edges]).reshape(-1, len(LABELS), len(LABELS))
    beliefs = _messages(unary, order, tables)
    places = [where[i] for i in live] + [(a, b) for a, b, _ in covered] + found
    more = []
    for n, k in enumerate(kinds):
        label = int(beliefs[n].argmax())
        if k is None and label and beliefs[n, label] >= threshold:
            more.append((LABELS[label], *places[n]))
    # of mentions that overlap, the first stays, of these the longest
    kept, floor = [], 0
    for k, a, b in sorted(more, key=lambda m: (m[1], -m[2])):
        if a >= floor:
            kept.append((k, a, b))
            floor = b
    return base, base + kept


def _joined(mention: str) -> str:
    """A mention of several tokens in the form of one: an address with (at), a number without spaces."""
    return _SPELT.sub("(at)", mention)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans count as one."""
    found = sorted(((a, b, k) for k, a, b in spans(text)[1]), key=lambda s: (s[0], -s[1]))
    if not found:
        return text
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


DIGEST = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def span_digest(column: str | Column) -> Column:
    """A struct of counts of base spans, the checksum of their list, and the list of all spans.

    Null and empty texts have none. Whole texts of any length are read, in time linear in their length.
    """

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, every = spans(text)
            kinds = [k for k, _, _ in base]
            rows.append(
                (*(kinds.count(k) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(every))
            )
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return digest(column)


def redact(column: str | Column) -> Column:
    """Texts with personal data replaced; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redacted, na_action="ignore")

    return clean(column)
