"""Personal data found by a skip-chain conditional random field.

The nodes of a text are its tokens with a digit or an @; its capitalised words, but
for those that only begin a sentence; what follows a word such as ``password`` or
``name`` as its value; words of streets beside numbers; and every further
occurrence of any of these words.  All other tokens are observed to be outside.
Neighbouring nodes share a chain potential.  Nodes of one document whose letters
and digits are the same, however far apart, share a skip potential, as do those
that are alike but for trailing or leading characters.  Labels come from loopy
message passing over each document's graph, so a value that is plain in one
place is found in all others.  The weights are fitted here by pseudo-likelihood to
sentences that a seeded generator writes and labels.
"""

from __future__ import annotations

import random
import re
import sys
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, text_batches
from .components import stars
from .words import _BASE, codepoints, mix, powers, tables

LABELS = ["O", "EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET", "PERSON", "ADDRESS"]
K = len(LABELS)
CHAIN, SAME, ALIKE = range(3)
#: Rounds of messages, at most; those of a connected part of a graph end when none there moves by TOLERANCE.
ROUNDS, TOLERANCE, DAMPING = 50, 1e-3, 0.3
#: Letters and digits at the beginning or end that two different tokens must share to be joined by a skip edge.
ALIKE_LEAST = 6
#: Digits of a number in pieces, at most: longer runs of tokens are several numbers.
MOST_DIGITS = {"PHONE": 19, "CARD": 19, "ID": 34}

SPANS = "doc_id long, start int, end int, kind string, score double"

#: Words that announce a value, by what it is.
HINTS = {
    "secret": "password passwd pwd passphrase passcode secret token key api_key apikey access_key secret_key private_key client_secret auth_token passwort kennwort schlüssel contraseña clave motdepasse credential credentials",
    "name": "name names mr mrs ms dr prof herr frau herrn monsieur madame mme señor señora sr sra dear regards sincerely signed author customer patient employee nombre nom kunde client sender recipient",
    "street": "street st avenue ave road rd lane ln drive boulevard blvd strasse straße gasse weg platz allee rue chemin impasse calle plaza avenida camino",
    "copula": "is was ist lautet est es",
}
_HINT = {w: kind for kind, line in HINTS.items() for w in line.split()}
#: Short for streets only where they are capitalised.
_SHORT = {"st", "rd", "ln", "ave"}
_STREET_END = re.compile(r"(?:straße|strasse|gasse|weg|platz|allee)$")
TOKEN, TRIGGER, UPPER, LOWER, HEX, ALNUM, BREAK, SIGN = (1 << i for i in range(8))


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per code point: in a token; a digit or @; upper and lower case; of a hexadecimal number; letter or digit; between sentences; between a name and its value."""
    c = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        s = chr(i)
        k = TRIGGER if s.isdecimal() or s == "@" else 0
        if s.isalnum():
            k |= TOKEN | ALNUM | UPPER * s.isupper() | LOWER * s.islower() | HEX * (s in "0123456789abcdefABCDEF")
        c[i] = k | TOKEN * (s in "._-+()@") | BREAK * (s in "!?;\n\r•|") | SIGN * (s in "=:\"'“”«»")
    return c


@dataclass
class Graph:
    """text: of each node; start, end: of its core; features; unary: fixed part; edges: (node, node, kind)."""

    text: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)


_CORE = re.compile(r"[^\W_+(:](?:.*[^\W_)])?|[+(].*[^\W_)]|::[0-9a-fA-F:]*", re.S)


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", s))


def _street(s: str) -> bool:
    s = s.strip("._-+():")
    low = s.lower()
    return bool(s) and (bool(_STREET_END.search(low)) or _HINT.get(low) == "street" and (low not in _SHORT or s[0].isupper()))


@lru_cache(1 << 16)
def _own_features(core: str) -> tuple[str, ...]:
    """What a token's own characters tell."""
    low = core.lower()
    digits, letters = sum(map(str.isdecimal, low)), sum(map(str.isalpha, low))
    if not digits and "@" not in low:
        case = "title" if core[0].isupper() and not core.isupper() else "upper" if core.isupper() else "lower"
        out = ["word", "case " + case, f"length {min(len(core), 24) // 3}"]
        if _street(core):
            out.append("street word")
        if low in _HINT:
            out.append("hint word " + _HINT[low])
        return tuple(out)
    parts = low.split(".")
    plain = low.replace("-", "")
    out = ["bias", "shape " + _shape(low), f"digits {min(digits, 20)}", f"letters {min(letters, 12)}", f"digits {min(digits, 20)} letters {min(letters, 3)}"]
    out.append("digit groups " + re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", "a", low)))
    if "@" in low:
        out.append("at")
        if re.fullmatch(r"[^@\s]+@[^@\s.]+(\.[^@\s.]+)+", low):
            out.append("address")
    if len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts):
        out.append("octets")
    if low.count(":") > 1:
        groups = low.split(":")
        six = re.fullmatch(r"(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}", low) and ("::" in low and len(groups) < 9 or len(groups) == 8)
        out.append("colons of six" if six else "colons of a device" if re.fullmatch(r"(?:[0-9a-f]{2}:){5}[0-9a-f]{2}", low) else "colons")
    if re.fullmatch(r"[0-9a-f]{12,}", low) and digits and letters:
        out.append("hex")
    if digits and letters and len(plain) >= 12 and plain.isalnum() and low.isascii():
        out.append("mixed")
    if plain.isdecimal() and 13 <= len(plain) <= 19:
        out.append("long number")
    if re.fullmatch(r"[a-z]{2}\d\d", low):
        out.append("country and check")
    return tuple(out)


@lru_cache(1 << 16)
def _word(s: str) -> str:
    s = s.strip("._-+():").lower()
    return s if s and (s.isalpha() or s in _HINT) else _shape(s)


def _case(s: str) -> str:
    s = s.lstrip("._-+(")
    return "none" if not s else "number" if s[0].isdecimal() else "title" if s[0].isupper() and not s.isupper() else "upper" if s.isupper() else "lower"


def _gap(s: str) -> str:
    """What stands between two tokens."""
    return "line" if "\n" in s else "=" if "=" in s else ":" if ":" in s else "quote" if any(c in s for c in "\"'“”«»") else "<" if "<" in s else "break" if any(c in s for c in ",;!?|") else "space" if s.strip() == "" else "other"


def _features(core: str, before: str, before2: str, after: str, more: list[str], gap: str, then: str, ended: bool, run: str) -> list[str]:
    own = _own_features(core)
    out = [*own, run]
    b, b2 = _word(before), _word(before2)
    hint, hint2 = _HINT.get(b, ""), _HINT.get(b2, "")
    hint, hint2 = (x if x != "street" else "" for x in (hint, hint2))
    if own[0] == "word":
        at = "initial" if ended or gap in ("line", "break", "") or not before else "mid"
        out += [f"{own[1]} {at}", f"{own[1]} before {_case(before)} {gap} ended {ended}", f"{own[1]} then {_case(after)} {then}", f"hint {hint} {gap} {own[1]}", f"hint {hint} {gap} {own[2]}"]
        if hint2:
            out.append(f"hint2 {hint2} {hint} {own[1]}")
        if hint:
            out.append(f"announced {hint} {own[1]}")
        ahead = [after, *more]
        names = next((k for k, x in enumerate(ahead) if _case(x) != "title"), len(ahead))
        if names < len(ahead) and "@" in ahead[names]:
            out.append(f"{own[1]} to mail, marked {then == '<' if not names else 'later'}")
        if "street word" in own:
            out.append(f"street word, {own[1]}, after {_case(before)}, then {_case(after)} {then}")
        if _street(after):
            out.append("to street")
        return out
    out += ["before " + b, "before2 " + b2, "after " + _shape(after.lower())]
    out += [f"hint {hint} {gap}"]
    if _street(before) or _street(before2) or _street(after):
        out.append(f"near street, digits {min(6, sum(map(str.isdecimal, core)))} {_case(after)}")
    if _case(after) == "title" and then == "space":
        out.append("to title")
    if "hex" in own or "mixed" in own:
        out += ["coded, before " + b, f"coded, hint {hint} {gap}"]
    return out


@lru_cache(1)
def _hint_hashes() -> dict[str, np.ndarray]:
    return {kind: np.sort(_tokens([line])[-1]) for kind, line in HINTS.items()}


def _tokens(texts: list[str]):
    """Of all texts: code points, where each text begins, classes, where tokens start and end, and hashes of their lower-case cores."""
    flat, begins = codepoints(texts)
    kind = _classes()[flat]
    inside = (kind & TOKEN) > 0
    colon = flat == 58
    if colon.any():
        # A run of hexadecimal digits and two colons or more is one token.
        run = colon | ((kind & HEX) > 0)
        edges = np.flatnonzero(np.diff(run.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        a, b = edges[::2], edges[1::2]
        colons = np.concatenate([[0], np.cumsum(colon)])
        some = colons[b] - colons[a] > 1
        a, b = a[some], b[some]
        alone = lambda i: (i < 0) | (i >= len(flat)) | ((kind[np.clip(i, 0, len(flat) - 1)] & ALNUM) == 0)
        digit = np.concatenate([[0], np.cumsum((kind & TRIGGER) > 0)])
        good = alone(a - 1) & alone(b) & (digit[b] > digit[a])
        change = np.zeros(len(flat) + 1, np.int64)
        np.add.at(change, a[good], 1)
        np.add.at(change, b[good], -1)
        inside |= np.cumsum(change)[:-1] > 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    letters = np.flatnonzero(kind & ALNUM)
    i, j = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
    some = j > i
    starts, ends, i, j = starts[some], ends[some], i[some], j[some]
    first, last = letters[i], letters[j - 1] + 1
    low, number = tables()
    up, down = powers(_BASE, len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(number[flat] * up[: len(flat)], out=sums[1:])
    return flat, begins, kind, starts, ends, first, mix((sums[last] - sums[first]) * down[first])


def _nodes(flat, begins, kind, starts, ends, first, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are nodes, and the text of each token."""
    n = len(starts)
    row = np.searchsorted(begins, starts, "right") - 1
    count = lambda flag: np.concatenate([[0], np.cumsum((kind & flag) > 0)])
    trigger = count(TRIGGER)
    trigger = trigger[ends] > trigger[starts]
    title = ((kind[first] & UPPER) > 0) & ((kind[np.minimum(first + 1, len(flat) - 1)] & LOWER) > 0)
    # To the token before: of the same text, no end of a sentence between, a sign between.
    same = np.zeros(n, bool)
    same[1:] = row[1:] == row[:-1]
    breaks, signs = count(BREAK), count(SIGN)
    behind = np.concatenate([[0], ends[:-1]])
    close = same & (breaks[starts] == breaks[behind]) & (starts - behind <= 4)
    joined = close.copy()
    joined[1:] &= flat[ends[:-1] - 1] != 46
    signed = close & (signs[starts] > signs[behind])
    hint = {k: np.isin(hashes, h) for k, h in _hint_hashes().items()}
    shift = lambda x, k: np.concatenate([np.zeros(k, bool), x[: n - k]]) if k <= n else np.zeros(n, bool)
    next_ = lambda x: np.append(x[1:], False)
    value = signed & shift(hint["secret"], 1) | close & shift(close, 1) & shift(hint["copula"], 1) & shift(hint["secret"], 2)
    value |= close & shift(hint["name"], 1) & (title | signed)
    words_ = title & (joined | next_(title & joined)) | value
    short = np.isin(hashes, np.sort(_tokens([" ".join(_SHORT)])[-1]))
    words_ |= hint["street"] & (title | ~short) & (joined & (shift(trigger | title, 1) | shift(joined, 1) & shift(trigger, 2)) | next_(joined & (trigger | title)))
    # Every further occurrence of such a word, in its text.
    key = mix(hashes + mix(row.astype(np.uint64)))
    again = np.isin(key, key[words_ & ~hint["street"] & ~hint["copula"]])
    return trigger | words_ | again, row


def graph(texts: list[str]) -> Graph:
    """The nodes and edges of all texts, of each on its own."""
    g = Graph()
    flat, begins, kind, starts, ends, first, hashes = _tokens(texts)
    if not len(starts):
        return g
    chosen, of = _nodes(flat, begins, kind, starts, ends, first, hashes)
    nodes = np.flatnonzero(chosen)
    # Offsets in its text of the tokens that a node looks at.
    around = nodes[:, None] + np.array([-2, -1, 0, 1, 2, 3])
    there = (around >= 0) & (around < len(starts))
    around = np.where(there, around, 0)
    there &= of[around] == of[nodes][:, None]
    base = begins[of[nodes]][:, None]
    s, e = np.where(there, starts[around] - base, 0).tolist(), np.where(there, ends[around] - base, 0).tolist()
    last_row, seen, last_token, last_node = -1, {}, -9, -1
    head, length = "", 0
    for t, row, (s2, s1, s0, s9, s8, s7), (e2, e1, e0, e9, e8, e7), (_, t1, _, t9, _, _) in zip(nodes.tolist(), of[nodes].tolist(), s, e, there.tolist()):
        if row != last_row:
            last_row, seen, last_token, last_node = row, {}, -9, -1
        text = texts[row]
        m = _CORE.search(text[s0:e0])
        if not m:
            continue
        core, at = m.group(), s0 + m.start()
        n = len(g.text)
        g.text.append(row)
        g.start.append(at)
        g.end.append(at + len(core))
        before, after = text[s1:e1], text[s9:e9]
        gap, ended = _gap(text[e1:s0]) if t1 else "", before.endswith(".")
        # What the run of numbers, or of words, begins with that the node is in.
        if last_token == t - 1 and gap == "space" and not ended and (core[0].isdecimal() or core[0] in "+(" or head.startswith("announced") or head.startswith("title")):
            length += 1
        else:
            length, own = 0, _own_features(core)
            hint = _HINT.get(_word(before), "") or (_HINT.get(_word(text[s2:e2]), "") if _HINT.get(_word(before)) == "copula" else "")
            head = "number " + ("country" if "country and check" in own else own[2]) if own[0] != "word" else f"announced {hint}" if hint in ("name", "secret") and t1 and gap != "line" else own[1].removeprefix("case ")
        g.features.append(_features(core, before, text[s2:e2], after, [text[s8:e8], text[s7:e7]], gap, _gap(text[e0:s9]) if t9 else "", ended, f"run {head} {min(length, 8)}"))
        g.outside.append(0)
        if last_token == t - 1 and last_node >= 0:
            g.edges.append((last_node, n, CHAIN))
        else:
            g.outside[n] |= 1
            if last_node >= 0:
                g.outside[last_node] |= 2
        last_token, last_node = t, n
        key = re.sub(r"[\W_]", "", core.lower())
        # Each occurrence is joined to the one before it and to the first: linear in their number, two steps across.
        for k, edge in ((key, SAME), (("head", key[:ALIKE_LEAST]), ALIKE), (("tail", key[-ALIKE_LEAST:]), ALIKE)):
            if edge == ALIKE and len(key) < ALIKE_LEAST:
                continue
            if k in seen:
                begin, previous, own = seen[k]
                if edge == SAME or own != key:
                    g.edges += [(o, n, edge) for o in {begin, previous}]
                seen[k] = (begin, n, key)
            else:
                seen[k] = (n, n, key)
    return g


@dataclass
class Field:
    """weights: of each feature, by label; pair: by kind of edge, label and label."""

    weights: dict[str, np.ndarray]
    pair: np.ndarray

    def unary(self, g: Graph) -> np.ndarray:
        known = [[w for f in fs if (w := self.weights.get(f)) is not None] for fs in g.features]
        u = np.array([np.sum(w, 0) if w else np.zeros(K) for w in known]).reshape(len(known), K)
        outside = np.array(g.outside, np.int64)
        u[(outside & 1) > 0] += self.pair[CHAIN][0]
        u[(outside & 2) > 0] += self.pair[CHAIN][:, 0]
        return u

    def beliefs(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Each node's probabilities of the labels, by loopy sum-product message passing.

        Each connected part stops on its own, so that a text's beliefs don't depend on
        the texts that it is read with; after ``rounds`` all stop.
        """
        u = self.unary(g)
        if g.edges:
            e = np.array(g.edges)
            nodes, low = stars(e[:, 0], e[:, 1])
            part = np.searchsorted(nodes, low[np.searchsorted(nodes, e[:, 0])])
            m = np.zeros((2, len(e), K))
            live = np.arange(len(e))
            for _ in range(rounds):
                a, b, psi = e[live, 0], e[live, 1], self.pair[e[live, 2]]
                now = m[:, live]
                total = u.copy()
                np.add.at(total, b, now[0])
                np.add.at(total, a, now[1])
                new = np.empty_like(now)
                for side, out in enumerate(((total[a] - now[1])[:, :, None] + psi, (total[b] - now[0])[:, :, None] + psi.transpose(0, 2, 1))):
                    top = out.max(1)
                    new[side] = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new -= new.max(2, keepdims=True)
                moved = np.zeros(len(nodes))
                np.maximum.at(moved, part[live], np.abs(new - now).max((0, 2)))
                m[:, live] = DAMPING * now + (1 - DAMPING) * new
                live = live[moved[part[live]] >= TOLERANCE]
                if not len(live):
                    break
            u = u.copy()
            np.add.at(u, e[:, 1], m[0])
            np.add.at(u, e[:, 0], m[1])
        u -= u.max(1, keepdims=True)
        p = np.exp(u)
        return p / p.sum(1, keepdims=True)


def find(texts: list[str], model: Field) -> list[tuple[int, int, int, str, float]]:
    """(text, start, end, kind, score) of each span.  Neighbouring tokens of a number in pieces, a name or an address make one span."""
    g = graph(texts)
    if not g.text:
        return []
    p = model.beliefs(g)
    best = p.argmax(1).tolist()
    out: list[tuple[int, int, int, str, float]] = []
    digits, last = 0, -2
    for i, y in enumerate(best):
        if not y:
            continue
        kind, t, s, e, score = LABELS[y], g.text[i], g.start[i], g.end[i], round(float(p[i, y]), 6)
        own = sum(map(str.isdecimal, texts[t][s:e]))
        if out and best[last] == y and out[-1][0] == t and (last == i - 1 or kind == "ADDRESS"):
            gap = texts[t][out[-1][2] : s]
            near = len(gap) <= (12 if kind == "ADDRESS" else 3) and "\n" not in gap
            if near and (kind in ("PERSON", "ADDRESS") and not set(gap) & set(".!?;|=") or digits + own <= MOST_DIGITS.get(kind, 0)):
                digits += own
                out[-1] = (t, out[-1][1], e, kind, min(out[-1][4], score))
                last = i
                continue
        digits, last = own, i
        out.append((t, s, e, kind, score))
    return out


# ---- training


_SYLLABLES = "an er in on re th ou es ti sch ge ung eau ción lla oi ment é ñ ü ra to be".split()


def _filler(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _name(r: random.Random) -> str:
    return _filler(r).capitalize()


def _iban(r: random.Random) -> str:
    return r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]) + _digits(r, r.choice([16, 18, 20, 20, 22, 25]))


def _values(r: random.Random) -> tuple[list[tuple[str, str]], list[str]]:
    """A value, as (token, label) pairs, and what may stand before it."""
    d, w = lambda n: _digits(r, n), lambda: _filler(r)
    kind = r.choice(["EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET", "PERSON", "ADDRESS", "O", "O", "O", "O"])
    if kind == "EMAIL":
        name = r.choice([w(), f"{w()}.{d(2)}", f"{w()}.{w()}", f"{w()}_{d(3)}", f"{w()}+{w()}"])
        host = r.choice([f"{w()}.com", f"mail{d(1)}.{w()}.com", f"{w()}{d(1)}.org", f"{w()}.{w()}.net", f"{w()}-{w()}.de"])
        if r.random() < 0.25:
            return [*((_name(r), "PERSON") for _ in range(r.randint(1, 2))), (f"<{name}@{host}>", kind)], ["to", "cc", w()]
        return [(f"{name}@{host}", kind)], ["mail", "email", "contact", w(), w(), w()]
    if kind == "PHONE":
        form = r.choice([f"+{d(r.randint(1, 2))} ({d(3)}) {d(3)}-{d(4)}"] * 3 + [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(11)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}"])
        return [(t, kind) for t in form.split()], ["phone", "call", "tel", w(), w(), w()]
    if kind == "IP":
        hexes = lambda n: ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(n)]
        six = r.choice([":".join(hexes(8)), f"{':'.join(hexes(r.randint(2, 3)))}::{':'.join(hexes(r.randint(1, 3)))}", f"2001:db8::{':'.join(hexes(r.randint(2, 3)))}"])
        return [(six if r.random() < 0.3 and any(map(str.isdecimal, six)) else ".".join(str(r.randint(0, 255)) for _ in range(4)), kind)], ["ip", "host", "from", w(), w()]
    if kind == "CARD":
        form = r.choice([d(16)] * 4 + [d(15), d(13), "-".join(d(4) for _ in range(4)), " ".join(d(4) for _ in range(4))])
        return [(t, kind) for t in form.split()], ["card", "number", w(), w(), w()]
    if kind == "ID":
        iban = _iban(r)
        form = r.choice([f"{d(3)}-{d(2)}-{d(4)}"] * 2 + [iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4)), ":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(5)) + ":0" + d(1)])
        return [(t, kind) for t in form.split()], ["ssn", "iban", "account", "mac", w(), w()]
    if kind == "SECRET":
        size = r.randint(12, 48)
        code = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(size))] * 3 + ["".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(size)), "AKIA" + "".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))])
        if r.random() < 0.25:
            # Of letters alone: only what stands before it tells.
            code = r.choice(["".join(w() for _ in range(3)), "".join(r.choice("abcdef") for _ in range(r.randint(12, 32))), "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(8, 24))), "".join(w().capitalize() for _ in range(3))])
        elif not (any(map(str.isdecimal, code)) and any(map(str.isalpha, code))):
            code += "a1"
        hints = [x for x in HINTS["secret"].split() if x.isascii()]
        return [(code, kind)], [r.choice(["token", "password", "secret", "key", "api_key", "passwd", "pwd", *hints])] * 5 + ([w()] if any(map(str.isdecimal, code)) else [])
    if kind == "PERSON":
        return [(_name(r), kind) for _ in range(r.choice([1, 2, 2, 2, 3]))], [r.choice([x, x.capitalize()]) for x in r.sample(HINTS["name"].split(), 4)]
    if kind == "ADDRESS":
        n, a = str(r.randint(1, 999)), _name(r)
        english = [x.capitalize() for x in "street st avenue ave road rd lane drive boulevard".split()]
        form = r.choice([f"{n} {a} {r.choice(english)}", f"{n} {a} {_name(r)} {r.choice(english)}", f"{_filler(r).capitalize()}{r.choice(['straße', 'strasse', 'gasse', 'weg', 'platz', 'allee'])} {n}", f"{n} {r.choice(['rue', 'chemin', 'impasse'])} {a}", f"{r.choice(['Calle', 'Plaza', 'Avenida'])} {a} {n}"])
        if r.random() < 0.3:
            form += f", {d(5)} {_name(r)}"
        return [(t, kind) for t in form.split()], ["at", "address", "in", w(), w(), w()]
    if r.random() < 0.35:
        # Words that are none: names of things, headlines, values in prose.
        return r.choice([[(_name(r), "O")], [(_name(r), "O") for _ in range(r.randint(2, 5))], [(_name(r), "O")] * r.randint(3, 30), [(_name(r), "O"), (_name(r), "O")] * r.randint(2, 12), [(d(2), "O"), (_name(r), "O")], [(_name(r), "O"), (d(r.randint(1, 4)), "O")], [(_filler(r)[:4], "O")], [(_filler(r)[:4], "O")]]), ["the", "of", "and", "und", "le", w(), w(), w(), r.choice(HINTS["secret"].split()), r.choice(HINTS["secret"].split())]
    form = r.choice([d(1), d(2), d(3), str(r.randint(1900, 2030)), d(5), d(6), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(2)}.{d(2)}", f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{w()}{d(1)}", f"{d(2)}th", f"v{d(1)}", f"{d(1)}-{d(1)}", f"{d(3)}.{d(3)}", f"@{w()}", f"{w()}-{d(2)}", f"({d(4)})", f"{d(1)} {d(2)}", f"{d(3)} {d(3)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"{d(2)}:{d(2)}"])
    return [(t, kind) for t in form.split()], ["version", "page", "in", "chapter", w(), w(), w(), w()]


def sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts: (text, [(start, end, label) of each token of a value])."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, gold = "", []

        def say(count):
            nonlocal text
            for _ in range(count):
                word = _filler(r) if r.random() < 0.985 else r.choice(list(_HINT))
                if (not text or text.rstrip()[-1:] in ".!?" or text.endswith("\n")) and r.random() < 0.8 or r.random() < 0.05:
                    word = word.capitalize()
                text += word + r.choice(["", "", "", "", ".", ",", ".\n"]) + " "

        def put(tokens, before, bare):
            nonlocal text
            kind = tokens[-1][1]
            if not bare:
                text += r.choice(before)
                alone = not any(c.isdecimal() for c in tokens[0][0])
                if kind == "SECRET" and alone:
                    text += r.choice([" = ", "=", ": ", ' = "', ' "', ":", " is "])
                elif kind == "PERSON":
                    text += r.choice([" ", " ", ". ", ": ", " = ", " is "])
                elif kind == "ADDRESS" or kind == "O" and alone:
                    text += r.choice([" ", " ", " ", ": ", " is "])
                else:
                    text += r.choice([" ", " ", " = ", "=", ": ", ' = "', ' "'])
            for t, label in tokens:
                if label == "EMAIL" and r.random() < 0.3 and text.endswith(" ") and t[0] != "<":
                    text = text[:-1] + "."
                own = t.strip("<>,")
                gold.append((len(text) + t.index(own), len(text) + t.index(own) + len(own), label))
                text += t + " "
            text = text[:-1] + r.choice(["", "", ".", ",", '"', "###", "!!", "%%%"]) + r.choice([" ", " ", "\n"])

        kept = []
        for _ in range(r.randint(1, 5)):
            say(r.randint(0, 6))
            tokens, before = _values(r)
            put(tokens, before, tokens[0][1] not in ("SECRET", "PERSON") and r.random() < 0.6)
            kept.append(tokens)
        for tokens in kept:
            # Some values come again, without a hint before them; of a name, a part may.
            for _ in range(r.choice([1, 1, 2] if tokens[0][1] == "PERSON" else [1, 1, 2, 6]) if r.random() < (0.6 if tokens[0][1] == "PERSON" else 0.35) else 0):
                say(r.randint(1, 5))
                put(tokens[-1:] if tokens[0][1] == "PERSON" and r.random() < 0.5 else tokens, [], True)
        say(r.randint(0, 3))
        if r.random() < 0.06:
            # Lines that come again and again tell nothing of their words.
            line = " ".join(r.choice([_filler(r), _name(r)]) for _ in range(r.randint(2, 6)))
            text += (line + r.choice([".", "", ","]) + r.choice(["\n", " "])) * r.randint(3, 25)
        out.append((text.upper() if r.random() < 0.1 and len(text.upper()) == len(text) and not any(k in ("PERSON", "ADDRESS") for *_, k in gold) else text, gold))
    return out


def gold(g: Graph, marked: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """The label of each node: that of the marked token that holds most of its core."""
    y = np.zeros(len(g.text), np.int64)
    for i, (t, s, e) in enumerate(zip(g.text, g.start, g.end)):
        over = [(min(e, b) - max(s, a), k) for a, b, k in marked[t] if min(e, b) > max(s, a)]
        y[i] = LABELS.index(max(over)[1]) if over else 0
    return y


@lru_cache(4)
def fit(n: int = 3000, epochs: int = 10, rate: float = 0.2, decay: float = 1e-5, seed: int = 11) -> Field:
    """Weights fitted by pseudo-likelihood, with Adagrad: each node's label given its features and its neighbours' labels.

    Each node is seen a second time without its neighbours, so that features tell
    what they can alone: where neighbours explain each other, none would begin.
    """
    data = sentences(n, seed)
    g = graph([t for t, _ in data])
    y = gold(g, [m for _, m in data])
    count: dict[str, int] = {}
    for fs in g.features:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    names = sorted(f for f, c in count.items() if c >= 3)
    place = {f: i for i, f in enumerate(names)}
    for k in range(3):
        for dir_ in "ab":
            for label in range(K):
                place[f"{k}{dir_}{label}"] = len(place)
    own = [[place[f] for f in fs if f in place] for fs in g.features]
    alone = [list(o) for o in own]
    for a, b, k in g.edges:
        own[b].append(place[f"{k}a{y[a]}"])
        own[a].append(place[f"{k}b{y[b]}"])
    for i, o in enumerate(g.outside):
        own[i] += [place[f"{CHAIN}a0"]] * (o & 1) + [place[f"{CHAIN}b0"]] * (o >> 1)
    own, y = own + alone, np.concatenate([y, y])
    rng = np.random.default_rng(seed)
    w, h = np.zeros((len(place), K)), np.full((len(place), K), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 192):
            some = order[i : i + 192]
            f = np.concatenate([own[j] for j in some]).astype(np.int64)
            r = np.repeat(np.arange(len(some)), [len(own[j]) for j in some])
            z = np.zeros((len(some), K))
            np.add.at(z, r, w[f])
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            u, at = np.unique(f, return_inverse=True)
            d = np.zeros((len(u), K))
            np.add.at(d, at, p[r] / len(some))
            d += decay * w[u]
            h[u] += d**2
            w[u] -= rate * d / np.sqrt(h[u])
    pair = np.zeros((3, K, K))
    for k in range(3):
        for label in range(K):
            # Both directions inform one potential: half of each, as each end's conditional holds all of it.
            pair[k, label, :] += 0.5 * w[place[f"{k}a{label}"]]
            pair[k, :, label] += 0.5 * w[place[f"{k}b{label}"]]
    for k in (SAME, ALIKE):
        pair[k] = (pair[k] + pair[k].T) / 2
    return Field({f: w[place[f]] for f in names}, pair)


# ---- on tables


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Field | None = None) -> DataFrame:
    """doc_id, start, end (characters; end exclusive), kind and score of each span of personal data.

    Null and empty texts have none, and no documents give no rows; texts of any
    length are read whole.  Each row is read on its own, so repeated rows give repeated
    spans, and rows with a null id give spans with it.  Of equally probable labels
    the first in LABELS is taken.  Other columns are ignored.  One narrow pass.

    Names and addresses are found by what stands around them, there or at another
    place of the document: no list of names is used.  Words in capitals only are
    no names unless a word announces them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        for keys, texts in text_batches(batches, "doc_id", "text"):
            found = find(texts, shared.value)
            if found:
                r, s, e, k, p = (list(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)).cast(pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(k), pa.array(p)], ["doc_id", "start", "end", "kind", "score"])

    return only(docs, doc_id=doc_id, text=text).where("text is not null").mapInArrow(run, SPANS)


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, kind) replaced by <KIND>."""
    out, at = [], 0
    for s, e, kind in sorted(found):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
            at = e
    return "".join(out) + text[at:]


def clean(docs: DataFrame, text: str = "text", model: Field | None = None) -> DataFrame:
    """All rows, in the same columns, with each span of personal data replaced by its kind in angle brackets.

    Null and empty texts stay as they are, texts of any length are read whole, repeated
    rows and rows with a null id stay, and no documents give no rows.  Columns of any
    name are carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit())

    def run(batches):
        for b in batches:
            column, kept, done = b.column(text), [], 0
            for _, part in text_batches([b], text, text):
                own = column.slice(done, len(part))
                by: dict[int, list[tuple[int, int, str]]] = {}
                for r, s, e, k, _p in find(part, shared.value):
                    by.setdefault(r, []).append((s, e, k))
                if by:
                    new = own.to_pylist()
                    for r, found in by.items():
                        new[r] = masked(part[r], found)
                    own = pa.array(new, column.type)
                kept.append(own)
                done += len(part)
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.concat_arrays(kept)) if kept else b

    return docs.mapInArrow(run, docs.schema)
