"""Personal data: stated patterns, and a semi-Markov conditional random field that adds disguised and unusual forms.

The field scores whole spans (digit groups, separators, check digits, signs around them), not single tokens.  Dynamic
programming over spans of bounded length chooses boundaries and types together; what no span covers costs nothing.  It
is trained on windows around the pattern matches of the corpus itself, as they stand and rewritten in ways the patterns
do not know, against number-like text that no pattern takes and spoilt copies (wrong check digit, part above 255).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
BOUND = 24  # tokens of the longest span the field may add
SAMPLE = 300  # windows to learn from, of each kind of match and of number-like text without one
WINDOW = 240  # characters of the longest window to learn from
MARGIN = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")

_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_DOT = rf"(?:\.|{_OPEN}(?:\.|dot){_CLOSE}|\bdot\b)"
_AT_SIGN = rf"(?:@|{_OPEN}at{_CLOSE}|\bat\b)"
_NUMBERS = re.compile(r"[0-9]+(?:[^\w\n]{1,4}(?:dot[^\w\n]{1,4})?[0-9]+)*", re.I)
_ADDRESS = re.compile(rf"({_AT_SIGN})\s?[A-Za-z0-9-]+(?:\s?{_DOT}\s?[A-Za-z0-9-]+)+", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\n|\S")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the stated patterns by start, then kind; linear in the text.

    A leftmost address starts where the run of its characters before the at-sign does, so runs without one are never
    tried at each of their characters.
    """
    found: list[Span] = []
    if "@" in text:
        used = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > used and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                used = m.end()
                found.append((at, 0, used))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 12:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Token:
    start: int
    end: int
    text: str
    kind: str  # L letters, D digits, else the sign itself


def _tokens(text: str, low: int, high: int) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(text, low, high):
        first = m[0][0]
        out.append(Token(m.start(), m.end(), m[0], "D" if "0" <= first <= "9" else "L" if first.isalpha() else first))
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches that hold every span the field may add, with the signs around them."""
    spots = []
    dotted = "dot" in text or "DOT" in text or "Dot" in text
    if "@" in text or dotted or ".]" in text or ".)" in text:
        for m in _ADDRESS.finditer(text):
            if m[1] == "@" or len(m[1]) > 2 or re.search(rf"\bdot\b|{_OPEN}\.", m[0], re.I):
                spots.append(m.span())
    for m in _NUMBERS.finditer(text) if _SOME.search(text) else ():
        if m.end() - m.start() >= 7 and (sum(c.isdigit() for c in m[0]) >= 7 or m[0].count(".") >= 3 or "dot" in m[0].lower()):
            spots.append(m.span())
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        low, high = max(0, a - MARGIN), min(len(text), b + MARGIN)
        while low > 0 and a - low < 512 and text[low - 1].isalnum():
            low -= 1
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _side(text: str, at: int) -> str:
    """Class of the character beside a span."""
    if at < 0 or at >= len(text):
        return "edge"
    c = text[at]
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def _around(text: str, tokens: list[Token], i: int, j: int) -> list[str]:
    left, right = _side(text, tokens[i].start - 1), _side(text, tokens[j].end)
    out = [f"left={left}", f"right={right}"]
    if left == "letter" or right in ("letter", "digit") or left == "digit":
        out.append("inside a word")
    if right in ".,-/:" and _side(text, tokens[j].end + 1) == "digit":
        out.append("number goes on")
    if left in ".,-/:" and _side(text, tokens[i].start - 2) == "digit":
        out.append("number went before")
    if left == "space" and _side(text, tokens[i].start - 2) == "digit":
        out.append("number before the blank")
    return out


def _digit_spans(text: str, tokens: list[Token], i: int) -> Iterator[tuple[int, int, list[str]]]:
    """Number-like spans from token ``i`` on: (last token, kind, features)."""
    groups: list[str] = []
    between: list[str] = []
    lead = signs = ""
    digits = 0
    for j in range(i, min(i + BOUND, len(tokens))):
        t = tokens[j]
        if j > i:
            gap = text[tokens[j - 1].end : t.start]
            if len(gap) > 2:
                return
            signs += " " if gap else ""
        if t.kind != "D":
            if t.text.lower() == "dot" and groups:
                signs += "dot"
            elif t.kind in "().-/_[]" and len(signs) < 8:
                signs += t.kind
            elif t.kind == "+" and not groups:
                signs += "+"
            else:
                return
            continue
        if groups:
            between.append(signs)
        else:
            lead = signs
        signs = ""
        groups.append(t.text)
        digits += len(t.text)
        if digits > 19 or len(groups) > 8:
            return
        if lead not in ("", "+", "(", "+(", "(+"):
            return
        kinds = []
        if len(groups) == 4 and not lead and all("." in b or "dot" in b for b in between) and all(len(g) <= 3 for g in groups):
            kinds.append(1)
        if 12 <= digits <= 19 and not lead and not any(c in "()[]" for b in between for c in b):
            kinds.append(2)
        if 7 <= digits <= 15 and not any(c in "[]_" or "dot" in b for b in between for c in b):
            kinds.append(3)
        if not kinds:
            continue
        around = _around(text, tokens, i, j)
        shape = "-".join(str(len(g)) for g in groups)
        forms = sorted(set(between)) or ["none"]
        common = [*around, f"separators={'|'.join(forms)}", f"{len(forms)} kinds of separator", f"{len(groups)} groups"]
        for kind in kinds:
            if kind == 1:
                yield j, 1, [*common, "parts fit" if all(int(g) <= 255 for g in groups) else "part above 255"]
            elif kind == 2:
                even = all(len(g) == 4 for g in groups[:-1]) or len(groups) == 1
                yield j, 2, [*common, "check digit right" if luhn("".join(groups)) else "check digit wrong", f"{digits} digits", "even groups" if even else f"groups={shape}"]
            else:
                balance = "".join([lead, *between])
                brackets = "none" if "(" not in balance else "pair" if balance.count("(") == balance.count(")") == 1 else "odd"
                yield j, 3, [*common, f"lead={lead}", f"groups={shape}", f"{digits} digits", f"brackets={brackets}"]


def _address_spans(text: str, tokens: list[Token]) -> Iterator[tuple[int, int, int, list[str]]]:
    """Address-like spans: (first token, last token, kind, features)."""

    def close(a: int, b: int) -> bool:
        return tokens[b].start - tokens[a].end <= 1

    def sign(at: int, word: str, mark: str) -> tuple[int, str] | None:
        """Token after an at or dot at ``at`` and its form."""
        if at >= len(tokens):
            return None
        t = tokens[at]
        if t.kind == mark:
            return at + 1, mark
        if t.text.lower() == word:
            return at + 1, word
        if t.kind in "[({<" and at + 2 < len(tokens) and tokens[at + 2].kind in "])}>" and (tokens[at + 1].text.lower() == word or tokens[at + 1].kind == mark):
            return at + 3, "bracket"
        return None

    for t in range(1, len(tokens)):
        found = sign(t, "at", "@")
        if found is None or not close(t - 1, t):
            continue
        after, at_form = found
        starts = []
        i = t - 1
        while i >= 0 and t - i <= 8 and (tokens[i].kind in ("L", "D") or tokens[i].kind in "._%+-"):
            if tokens[i].kind in ("L", "D"):
                starts.append(i)
            if i == 0 or tokens[i - 1].end != tokens[i].start:
                break
            i -= 1
        ends = []
        at, labels, forms = after, 0, set()
        while at < len(tokens) and at - t <= BOUND and tokens[at].kind in ("L", "D") and close(at - 1, at):
            while at + 1 < len(tokens) and tokens[at + 1].kind in ("L", "D", "-") and tokens[at + 1].start == tokens[at].end:
                at += 1
            labels += 1
            if labels > 1:
                ends.append((at, labels, "|".join(sorted(forms)), tokens[at]))
            nxt = sign(at + 1, "dot", ".")
            if nxt is None or not close(at, at + 1) or nxt[0] >= len(tokens):
                break
            forms.add(nxt[1])
            at = nxt[0]
        spaced = tokens[t].start > tokens[t - 1].end
        for i in starts:
            for j, labels, dots, last in ends:
                if j - i >= BOUND or (at_form == "at" and dots == "."):
                    continue
                top = "letters" if last.kind == "L" else "digits"
                yield (
                    i, j, 0,
                    [*_around(text, tokens, i, j), f"at={at_form}", f"at={at_form} blank={spaced}", f"dots={dots}", f"top={top}", f"top of {min(len(last.text), 8)}",
                     "whole" if j == ends[-1][0] else "domain goes on", "whole name" if i == starts[-1] else "name goes on", f"{min(labels, 4)} labels"],
                )


def candidates(text: str, low: int, high: int) -> list[tuple[int, int, int, list[str]]]:
    """Spans the field may add in a stretch: (start, end, kind, features), by end, then start and kind."""
    tokens = _tokens(text, low, high)
    out = []
    for i, t in enumerate(tokens):
        if t.kind == "D" or t.kind in "+(":
            for j, kind, features in _digit_spans(text, tokens, i):
                out.append((t.start, tokens[j].end, kind, features))
    for i, j, kind, features in _address_spans(text, tokens):
        out.append((tokens[i].start, tokens[j].end, kind, features))
    out.sort(key=lambda s: (s[1], s[0], s[2]))
    return out


@dataclass
class Model:
    """Weights of span features by kind, and of one kind following another in a stretch (the last row: none before)."""

    weights: dict[str, float] = field(default_factory=dict)
    follow: list[list[float]] = field(default_factory=lambda: [[0.0] * len(KINDS) for _ in range(len(KINDS) + 1)])

    def score(self, kind: int, features: list[str]) -> float:
        name = KINDS[kind]
        return sum(self.weights.get(f"{name}: {f}", 0.0) for f in ("span", *features))

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Best set of disjoint spans beside the base ones."""
        out: list[Span] = []
        if not self.weights:
            return out
        for low, high in islands(text):
            fixed = [b for b in base if b[2] > low and b[0] < high]
            spans = [s for s in candidates(text, low, high) if not any(s[0] < b[2] and b[0] < s[1] for b in fixed)]
            if spans:
                out += self._best(spans, fixed)
        return out

    def _best(self, spans: list, fixed: list[Span]) -> list[Span]:
        none = len(KINDS)
        # chart: at each place the best score and history by kind of the last span
        places = sorted({p for s in spans for p in s[:2]} | {b[2] for b in fixed})
        ending: dict[int, list] = {}
        for s in spans:
            ending.setdefault(s[1], []).append((s[0], s[2], self.score(s[2], s[3])))
        kind_at = {b[2]: b[1] for b in fixed}
        chart: dict[int, dict[int, tuple[float, tuple]]] = {}
        now: dict[int, tuple[float, tuple]] = {none: (0.0, ())}
        for place in places:
            now = dict(now)
            for start, kind, score in ending.get(place, ()):
                for last, (total, history) in chart[start].items():
                    new = total + score + self.follow[last][kind]
                    if kind not in now or new > now[kind][0]:
                        now[kind] = new, (history, (start, kind, place))
            if place in kind_at:
                now = {kind_at[place]: max(now.values(), key=lambda w: w[0])}
            chart[place] = now
        history, out = max(now.values(), key=lambda w: w[0])[1], []
        while history:
            history, span = history
            out.append(span)
        return out[::-1]


def disguised(kind: int, span: str, turn: int) -> list[str]:
    """Forms of a pattern's match that the patterns do not take."""
    if kind == 0:
        name, domain = span.split("@")
        forms = [
            f"{name} at {domain.replace('.', ' dot ')}", f"{name}[at]{domain}", f"{name} [at] {domain.replace('.', ' [dot] ')}",
            f"{name}(at){domain.replace('.', '(dot)')}", f"{name} @ {domain}", f"{name}@{domain.replace('.', '[.]')}", f"{name} AT {domain.replace('.', ' DOT ')}",
        ]
    elif kind == 1:
        forms = [span.replace(".", x) for x in ("[.]", " . ", "(dot)", " dot ", "[dot]", ". ")]
    elif kind == 2:
        digits = re.sub("[^0-9]", "", span)
        parts = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        forms = [x.join(parts) for x in (".", "/", "_", "  ", " - ")]
    else:
        digits = re.sub("[^0-9]", "", span)
        area, first, last, land = digits[-10:-7] or "201", digits[-7:-4], digits[-4:], digits[:-10] or "1"
        forms = [
            f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"00{land} {area} {first} {last}",
            f"+{land}/{area}/{first}/{last}", f"({area}) {first} {last}", f"00{land}-{area}-{first}-{last}",
        ]
    return [forms[turn % len(forms)], forms[(turn // 7 + 1) % len(forms)]]


def spoilt(kind: int, span: str, turn: int) -> str:
    """A near miss of a pattern's match that is no personal data."""
    if kind == 0:
        return ("look at " if turn % 2 else "point at ") + span.split("@")[1].replace(".", ". ")
    if kind == 1:
        parts = span.split(".")
        parts[turn % 4] = str(256 + turn % 700)
        return "[.]".join(parts) if turn % 2 else ".".join(parts)
    if kind == 2:
        wrong = span[:-1] + str((int(span[-1]) + 1 + turn % 9) % 10)
        return wrong if turn % 2 else "-".join(re.findall(".{1,4}", re.sub("[^0-9]", "", wrong)))
    digits = re.sub("[^0-9]", "", span)
    return (f"20{digits[-2:]}-{digits[:2]}-{digits[2:4]} {digits[4:6]}", f"{digits[:2]}.{digits[2:4]}.{digits[4:9]}", digits, f"{digits[:5]}/{digits[5:]}")[turn % 4]


Example = tuple[str, list[Span]]


def examples(windows: list[str]) -> list[Example]:
    """Windows as they stand, rewritten and spoilt, with their true spans."""
    out: list[Example] = []
    for window in windows:
        base = base_spans(window)
        out.append((window, base))
        for at, kind, end in base:
            if any(b != (at, kind, end) and b[0] < end and at < b[2] for b in base):
                continue
            turn = zlib.crc32(window[at:end].encode())
            for form in disguised(kind, window[at:end], turn):
                moved = [(s if s < at else s + len(form) - (end - at), k, e if s < at else e + len(form) - (end - at)) for s, k, e in base if s != at or k != kind]
                out.append((window[:at] + form + window[end:], sorted([*moved, (at, kind, at + len(form))])))
            wrong = spoilt(kind, window[at:end], turn)
            changed = window[:at] + wrong + window[end:]
            out.append((changed, base_spans(changed)))
    return out


def fit(found: list[Example], rounds: int = 160, rate: float = 0.15, decay: float = 2e-3) -> Model:
    """Conditional likelihood by forward and backward sums over all segmentations of all windows at once."""
    names: dict[str, int] = {}
    segments, events, gold = [], [], []
    for text, truth in found:
        spans = candidates(text, 0, len(text))
        right = {(s, e, k) for s, k, e in truth}
        # what the field cannot reach, or overlaps another true span, is no lesson
        reach = {s[:3] for s in spans}
        if not spans or not right <= reach or any(a < d and c < b for a, b, k in right for c, d, m in right if (a, b, k) < (c, d, m)):
            continue
        places = {p: i for i, p in enumerate(sorted({p for s in spans for p in s[:2]}))}
        row, line = len(events), []
        chosen = sorted(right)
        before = {seg: KINDS.index(KINDS[chosen[i - 1][2]]) if i else len(KINDS) for i, seg in enumerate(chosen)}
        for place, number in places.items():
            if number:
                line.append(-number)
            for start, end, kind, features in spans:
                if end == place:
                    line.append(len(segments))
                    ids = [names.setdefault(f"{KINDS[kind]}: {f}", len(names)) for f in ("span", *features)]
                    segments.append((row, places[start], number, kind, ids))
                    gold.append(before.get((start, end, kind), -1))
        events.append(line)
    model = Model()
    if not segments or max(gold) < 0:
        return model
    kinds = len(KINDS)
    row, begin, stop, kind = (np.array([s[i] for s in segments]) for i in range(4))
    gold = np.array(gold)
    flat = np.concatenate([s[4] for s in segments])
    owner = np.repeat(np.arange(len(segments)), [len(s[4]) for s in segments])
    depth = max(len(e) for e in events)
    table = np.full((depth, len(events)), np.iinfo(np.int64).max)
    for r, line in enumerate(events):
        table[: len(line), r] = line
    plan = []
    for step in table:
        moves = np.flatnonzero(step < 0)
        takes = np.flatnonzero((step >= 0) & (step < np.iinfo(np.int64).max))
        plan.append((moves, -step[moves], step[takes]))
    width = int(stop.max()) + 1
    final = np.zeros(len(events), dtype=np.int64)
    np.maximum.at(final, row, stop)
    weights, follow = np.zeros(len(names)), np.zeros((kinds + 1, kinds))
    theta = np.zeros(len(names) + follow.size)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    target = np.bincount(flat, weights=(gold >= 0)[owner].astype(float), minlength=len(names))
    target_follow = np.zeros_like(follow)
    np.add.at(target_follow, (gold[gold >= 0], kind[gold >= 0]), 1.0)
    for turn in range(1, rounds + 1):
        weights, follow = theta[: len(names)], theta[len(names) :].reshape(follow.shape)
        score = np.bincount(owner, weights=weights[flat], minlength=len(segments))
        alpha = np.full((len(events), width, kinds + 1), -np.inf)
        alpha[:, 0, kinds] = 0.0
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(events)), final] = 0.0
        # a stretch may start with a span at place 0; places are carried on from one to the next
        for moves, to, takes in plan:
            alpha[moves, to] = alpha[moves, to - 1]
            if takes.size:
                into = np.logaddexp.reduce(alpha[row[takes], begin[takes]] + follow[:, kind[takes]].T, axis=1) + score[takes]
                alpha[row[takes], stop[takes], kind[takes]] = np.logaddexp(alpha[row[takes], stop[takes], kind[takes]], into)
        for moves, to, takes in reversed(plan):
            if takes.size:
                back = follow[:, kind[takes]].T + (score[takes] + beta[row[takes], stop[takes], kind[takes]])[:, None]
                beta[row[takes], begin[takes]] = np.logaddexp(beta[row[takes], begin[takes]], back)
            beta[moves, to - 1] = np.logaddexp(beta[moves, to - 1], beta[moves, to])
        total = np.logaddexp.reduce(alpha[np.arange(len(events)), final], axis=1)
        with np.errstate(invalid="ignore"):
            mass = alpha[row, begin] + follow[:, kind].T + (score + beta[row, stop, kind] - total[row])[:, None]
        mass = np.exp(np.where(np.isnan(mass), -np.inf, mass))
        want = np.bincount(flat, weights=mass.sum(axis=1)[owner], minlength=len(names))
        want_follow = np.zeros_like(follow)
        for k in range(kinds):
            want_follow[:, k] = mass[kind == k].sum(axis=0)
        slope = np.concatenate(((target - want), (target_follow - want_follow).ravel())) / len(events) - decay * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    weights, follow = theta[: len(names)], theta[len(names) :].reshape(follow.shape)
    model.weights = {n: float(weights[i]) for n, i in names.items() if math.isfinite(weights[i])}
    model.follow = follow.tolist()
    return model


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to learn from, once a batch: the kind of a match in them or ``none``."""
    for batch in batches:
        found = set()
        for value in batch.column("text"):
            text = value.as_py() or ""
            if not _SOME.search(text):
                continue
            base = base_spans(text)
            for low, high in islands(text):
                if high - low > WINDOW:
                    continue
                window = text[low:high]
                here = {KINDS[k] for s, k, e in base if s >= low and e <= high}
                found.update((k, window) for k in here or ("none",))
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "window"]
        )


def sample(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` different windows of each kind and as many without a match, by their hash: a bounded sample of the texts.

    Windows of 240 characters at most, so a sample is under 2 MB.  Rerun, it is the same.
    """
    rows = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = rows.mapInArrow(_windows, "kind string, window string").distinct().withColumn("h", F.xxhash64("window"))
    place = F.row_number().over(W.partitionBy("kind").orderBy("h", "window"))
    chosen = found.withColumn("place", place).where(F.col("place") <= most).select("window").distinct().collect()
    return sorted(r.window for r in chosen)


def train(docs: DataFrame, most: int = SAMPLE) -> Model:
    """The field learned from a bounded sample of windows; where no pattern matches anywhere it adds nothing."""
    return fit(examples(sample(docs, most)))


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, base, spans``: the patterns' spans, and these with those the field adds, by start, then kind.

    Spans count code points, end exclusive.  Base spans of different kinds may overlap; added ones overlap nothing.  Each whole
    text is one task's work and no row moves.  Null and empty texts have no spans; repeated rows are answered each;
    a null id stays null; extra columns are ignored; an empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        for batch in batches:
            base, spans = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                mine = base_spans(text) if _SOME.search(text) else []
                more = model.added(text, mine)
                base.append(listed(mine))
                spans.append(listed(sorted([*mine, *more])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _KIND), pa.array(spans, _KIND)], names=["doc_id", "base", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """One row per document: base spans by kind, the hash of their list, and the list of all spans."""

    def joined(column: str):
        return F.expr(f"array_join(transform({column}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")

    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
