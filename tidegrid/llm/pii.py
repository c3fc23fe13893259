"""Personal data: patterns, and a character model that adds to what they find.

The model is a bidirectional LSTM over characters with a CRF over tags, trained in numpy on labelled spans: those that the
patterns find, secrets that are assigned to a telling name, and the same again in disguise, as people write them when no
pattern shall match: "jo (at) mail dot example dot com", numbers in other groups, secrets without a name in front or of
letters alone. So it learns from the characters and their surroundings what the patterns can't say. It reads the
surroundings of every digit, every @, every spelled-out "at", of what is assigned to a name and of every long run of
letters, of the whole text in overlapping windows; where windows overlap their emissions are averaged, and one Viterbi
path covers a stretch. Very long stretches are decoded in runs that overlap, and their spans put together again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, checkpointed, give_back, texts_of

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # Only the first digit of a run can begin a match, and no part of a run can do what the whole can't.
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: Kinds that the model knows: those of the patterns, and secrets such as keys and tokens, which it alone finds.
TAGS = (*KINDS, "secret")
#: A secret that its name gives away; labels for the model, not a pattern that finds.
NAMED_SECRET = re.compile(r"""(?i:token|secret|passw(?:or)?d|api_?key|auth)\s*[=:]\s*["']?([A-Za-z0-9_\-]{16,128})""")

#: Labelled stretches of each kind that the model is fitted on, at most; window and step; what surrounds a digit; layers; passes; the least mean probability of an added span.
LABELLED, WINDOW, STEP, AROUND, EMBED, HIDDEN, PASSES, SURE = 300, 64, 32, 32, 8, 16, 12, 0.9
#: Characters that are decoded as one, what longer stretches' runs share with their neighbours on each side, and characters that a worker holds the emissions of.
RUN, LAP, TOGETHER = 1024, 64, 1 << 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern counts."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str):
    """The leftmost non-overlapping matches, looked for around each @ alone: linear in long runs without one."""
    pattern, at, done = PATTERNS["email"], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = pattern.match(text, start) if start < at else None
        if m:
            yield m
        done = m.end() if m else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find, by start, then kind as listed."""
    found = []
    for kind, pattern in PATTERNS.items():
        if kind == "email":
            matches = _emails(text)
        elif kind == "phone" and "+" not in text:
            continue
        else:
            matches = pattern.finditer(text)
        found += [(m.start(), m.end(), kind) for m in matches if valid(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_TRIGGER = re.compile(r"""[0-9@]+|(?<=[\[({<])(?:at|AT)(?=[\])}>])|(?<= )(?:at|AT)(?= [A-Za-z0-9-]+ (?:dot|DOT) )|[=:]\s{0,2}["']?[A-Za-z0-9_-]{12,}|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}""")


def stretches(text: str) -> list[tuple[int, int]]:
    """The surroundings of digits, @ and spelled-out "at", of what is assigned to a name and of long runs, merged where they meet."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def codes(text: str) -> np.ndarray:
    """ASCII characters as themselves, other letters as 1, the rest as 2; all digits as the same."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    code = np.where(raw < 128, raw, 1).astype(np.int64)
    code[(code >= 48) & (code <= 57)] = 48
    return code


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x, w, b):
    """Forward over x: steps x rows x inputs. Returns the outputs and what the backward pass needs."""
    steps, rows, _ = x.shape
    h_n = b.shape[0] // 4
    h, c = np.zeros((rows, h_n), x.dtype), np.zeros((rows, h_n), x.dtype)
    out, kept = np.empty((steps, rows, h_n), x.dtype), []
    wx, wh = w[: x.shape[2]], w[x.shape[2] :]
    pre = x @ wx + b
    for t in range(steps):
        z = pre[t] + h @ wh
        g = _sigmoid(z[:, : 3 * h_n])
        i, f, o, u = g[:, :h_n], g[:, h_n : 2 * h_n], g[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
        kept.append((h, c, i, f, o, u))
        c = f * c + i * u
        h = o * np.tanh(c)
        out[t] = h
    return out, (kept, c)


def _lstm_back(x, w, out, memory, d_out):
    kept, c = memory
    h_n = out.shape[2]
    wx, wh = w[: x.shape[2]], w[x.shape[2] :]
    dz = np.empty((*out.shape[:2], 4 * h_n), x.dtype)
    dh, dc, dwh = np.zeros_like(out[0]), np.zeros_like(out[0]), np.zeros_like(wh)
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, u = kept[t]
        dh = dh + d_out[t]
        tc = np.tanh(c)
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        dwh += h.T @ dz[t]
        dh, dc, c = dz[t] @ wh.T, dc * f, before
    flat = dz.reshape(-1, 4 * h_n)
    return np.concatenate([x.reshape(len(flat), -1).T @ flat, dwh]), flat.sum(0), dz @ wx.T


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Tags are 0 for none and 1 + the number in TAGS."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        t = len(TAGS) + 1
        r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        return cls({"embed": r(128, EMBED) * 8, "wf": r(EMBED + HIDDEN, 4 * HIDDEN), "bf": bias, "wb": r(EMBED + HIDDEN, 4 * HIDDEN), "bb": bias.copy(), "out": r(2 * HIDDEN, t), "bo": np.zeros(t, np.float32), "move": np.zeros((t, t), np.float32)})

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: rows x steps of codes. Returns steps x rows x tags."""
        p = self.p
        e = p["embed"][x.T]
        f, mf = _lstm(e, p["wf"], p["bf"])
        b, mb = _lstm(e[::-1], p["wb"], p["bb"])
        h = np.concatenate([f, b[::-1]], axis=2)
        y = h @ p["out"] + p["bo"]
        return (y, (e, f, mf, b, mb, h)) if keep else y

    def gradient(self, x: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradient. mask: rows x steps, true to the left."""
        p = self.p
        y, (e, f, mf, b, mb, h) = self.emissions(x, keep=True)
        steps, rows, t_n = y.shape
        m, tag, move = mask.T, tags.T, p["move"].astype(np.float64)
        y64 = y.astype(np.float64)
        alpha, beta = np.empty_like(y64), np.zeros_like(y64)
        alpha[0] = y64[0]
        for t in range(1, steps):
            alpha[t] = np.where(m[t][:, None], _lse(alpha[t - 1][:, :, None] + move, 1) + y64[t], alpha[t - 1])
        for t in range(steps - 2, -1, -1):
            beta[t] = np.where(m[t + 1][:, None], _lse(move + (y64[t + 1] + beta[t + 1])[:, None, :], 2), 0)
        log_z = _lse(alpha[-1], 1)
        dy = np.exp(alpha + beta - log_z[None, :, None]) * m[:, :, None]
        gold = np.zeros(rows)
        d_move = np.zeros_like(move)
        for t in range(steps):
            gold += np.where(m[t], y64[t][np.arange(rows), tag[t]], 0)
            dy[t][np.arange(rows), tag[t]] -= m[t]
            if t:
                gold += np.where(m[t], move[tag[t - 1], tag[t]], 0)
                pair = np.exp(alpha[t - 1][:, :, None] + move + (y64[t] + beta[t])[:, None, :] - log_z[:, None, None])
                d_move += (pair * m[t][:, None, None]).sum(0)
                np.add.at(d_move, (tag[t - 1][m[t]], tag[t][m[t]]), -1)
        dy = (dy / rows).astype(np.float32)
        dh = dy @ p["out"].T
        n = HIDDEN
        dwf, dbf, def_ = _lstm_back(e, p["wf"], f, mf, dh[:, :, :n])
        dwb, dbb, deb = _lstm_back(e[::-1], p["wb"], b, mb, dh[::-1, :, n:])
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, x.T.ravel(), (def_ + deb[::-1]).reshape(-1, EMBED))
        flat = dy.reshape(-1, t_n)
        grads = {"embed": d_embed, "wf": dwf, "bf": dbf, "wb": dwb, "bb": dbb, "out": h.reshape(len(flat), -1).T @ flat, "bo": flat.sum(0), "move": (d_move / rows).astype(np.float32)}
        return float((log_z - gold).mean()), grads

    def train(self, x: np.ndarray, tags: np.ndarray, mask: np.ndarray, passes: int = PASSES, rows: int = 32, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each pass."""
        rng = np.random.default_rng(seed)
        m1, m2, step, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0, []
        for _ in range(passes):
            seen = []
            order = rng.permutation(len(x))
            for a in range(0, len(x), rows):
                i = order[a : a + rows]
                loss, g = self.gradient(x[i], tags[i], mask[i])
                seen.append(loss)
                step += 1
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / max(size, 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, ys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best path over each y (steps x tags), and the probability of each of its tags. All advance together, the longest first."""
        order = sorted(range(len(ys)), key=lambda k: -len(ys[k]))
        size = np.array([len(ys[k]) for k in order])
        steps, rows, tags = int(size[0]), len(ys), len(TAGS) + 1
        move = self.p["move"].astype(np.float64)
        y = np.zeros((steps, rows, tags))
        for j, k in enumerate(order):
            y[: size[j], j] = ys[k]
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        back = np.zeros((steps, rows, tags), np.int8)
        alpha, beta, best = np.zeros_like(y), np.zeros_like(y), y[0].copy()
        alpha[0] = y[0]
        for t in range(1, steps):
            n = live[t]
            scores = best[:n, :, None] + move
            back[t, :n] = scores.argmax(1)
            best[:n] = scores.max(1) + y[t, :n]
            alpha[t, :n] = _lse(alpha[t - 1, :n, :, None] + move, 1) + y[t, :n]
        path = np.zeros((steps, rows), np.int64)
        path[size - 1, np.arange(rows)] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            n = live[t]
            beta[t - 1, :n] = _lse(move + (y[t, :n] + beta[t, :n])[:, None, :], 2)
            path[t - 1, :n] = back[t, np.arange(n), path[t, :n]]
        log_z = _lse(alpha[size - 1, np.arange(rows)], 1)
        at = np.take_along_axis(alpha + beta, path[:, :, None], 2)[:, :, 0]
        sure = np.exp(np.minimum(at - log_z, 0))
        out: list = [None] * rows
        for j, k in enumerate(order):
            out[k] = path[: size[j], j], sure[: size[j], j]
        return out


def windows(code: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Overlapping windows of a stretch: (start, codes)."""
    starts = list(range(0, max(1, len(code) - WINDOW + STEP), STEP))
    return [(a, code[a : a + WINDOW]) for a in starts]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x, mask = np.zeros((len(parts), WINDOW), np.int64), np.zeros((len(parts), WINDOW), bool)
    for k, part in enumerate(parts):
        x[k, : len(part)], mask[k, : len(part)] = part, True
    return x, mask


def runs_of(a: int, b: int) -> list[tuple[int, int, int, int]]:
    """A stretch as runs: start, end, and what of it counts. A short one is one run; those of a long one overlap by LAP on both sides of what counts."""
    if b - a <= RUN:
        return [(a, b, a, b)]
    return [(max(a, s - LAP), min(b, s + RUN - LAP), s, min(b, s + RUN - 2 * LAP)) for s in range(a, b, RUN - 2 * LAP)]


def _tagged(tagger: Tagger, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tags and their probabilities of each run of codes; emissions are averaged where windows overlap. Equal runs are decoded once."""
    index: dict[bytes, int] = {}
    which = [index.setdefault(code.astype(np.uint8).tobytes(), len(index)) for code in parts]
    if len(index) < len(parts):
        found = _tagged(tagger, [np.frombuffer(raw, np.uint8).astype(np.int64) for raw in index])
        return [found[k] for k in which]
    places = [(j, start, part) for j, code in enumerate(parts) for start, part in windows(code)]
    total = [np.zeros((len(code), len(TAGS) + 1)) for code in parts]
    n = [np.zeros(len(code)) for code in parts]
    for at in range(0, len(places), 512):
        some = places[at : at + 512]
        # Padding sits to the right; the backward pass starts there from a blank, as it did in training.
        y = tagger.emissions(_padded([part for *_, part in some])[0])
        for i, (j, start, part) in enumerate(some):
            total[j][start : start + len(part)] += y[: len(part), i]
            n[j][start : start + len(part)] += 1
    averaged = [t / k[:, None] for t, k in zip(total, n)]
    order = sorted(range(len(parts)), key=lambda j: -len(parts[j]))
    out: list = [None] * len(parts)
    at = 0
    while at < len(order):
        # As many as fill a table of TOGETHER steps.
        some = order[at : at + max(1, min(256, TOGETHER // len(parts[order[at]])))]
        for j, found in zip(some, tagger.decode([averaged[j] for j in some])):
            out[j] = found
        at += len(some)
    return out


def model_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """What the model finds in each text, and is sure of. However long a stretch is, a bounded part of it is held at a time."""
    wanted = [(k, a, *run) for k, text in enumerate(texts) for a, b in stretches(text) for run in runs_of(a, b)]
    # text, stretch, start, end, tag, sum of probabilities; a span goes on in the next run of its stretch.
    spans: list[list] = []
    at = 0
    while at < len(wanted):
        to, held = at, 0
        while to < len(wanted) and (to == at or held + wanted[to][3] - wanted[to][2] <= TOGETHER):
            held += wanted[to][3] - wanted[to][2]
            to += 1
        some = wanted[at:to]
        for (k, stretch, start, _, first, end), (path, sure) in zip(some, _tagged(tagger, [codes(texts[k][x:y]) for k, _, x, y, _, _ in some])):
            path, sure = path[first - start : end - start], sure[first - start : end - start]
            edges = np.flatnonzero(np.diff(path, prepend=-1, append=-1))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                tag, total = int(path[s]), float(sure[s:e].sum())
                if s == 0 and spans and spans[-1][:2] == [k, stretch] and spans[-1][3:5] == [first, tag]:
                    spans[-1][3], spans[-1][5] = first + e, spans[-1][5] + total
                elif tag:
                    spans.append([k, stretch, first + s, first + e, tag, total])
        at = to
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, _, start, end, tag, total in spans:
        if total >= SURE * (end - start):
            out[k].append((start, end, TAGS[tag - 1]))
    return out


_DOT, _AT = (rf"(?:\s?{sign}\s?|\s?[\[({{<](?i:{word})[\])}}>]\s?|\s(?i:{word})\s)" for sign, word in ((r"\.", "dot"), ("@", "at")))
_LOOSE = {
    "email": re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,9}(?:\s?\.\s?[0-9]{1,9}){3}"),
    "card": re.compile(r"[0-9]+(?:[\s./_-]{1,2}[0-9]+)*"),
    "phone": re.compile(r"(?:\+|00)?\s?\(?[0-9]+(?:[\s().-]{1,2}[0-9]+)+"),
    "secret": re.compile(r"[A-Za-z0-9_-]{16,}"),
}
_ASSIGNED = re.compile(r"""[=:]\s{0,2}["']?$""")


def plausible(kind: str, found: str, before: str = "") -> bool:
    """What an added span must hold besides the model's word: a looser form than the pattern's, and the kind's own check. A secret without a digit must be assigned to something."""
    if not _LOOSE[kind].fullmatch(found):
        return False
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in re.findall("[0-9]+", found))
    if kind == "secret":
        return any(c.isalpha() for c in found) and (any(c.isdigit() for c in found) or bool(_ASSIGNED.search(before)))
    return valid(kind, found)


_RUN_START, _RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"), re.compile(r"[A-Za-z0-9_-]*")


def trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The span without spaces, quotes and full stops at its ends; a secret is the whole run of its characters."""
    while start < end and text[start] in " \t\n\"'.,;:=":
        start += 1
    while end > start and text[end - 1] in " \t\n\"'.,;:=":
        end -= 1
    if kind == "secret" and start < end:
        while start and text[start - 1] in _RUN_START:
            start -= 1
        end = _RUN.match(text, end).end()
    return start, end


def find_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """For each text the spans of the patterns, and these with the model's spans that touch none of them."""
    out = []
    for text, added in zip(texts, model_spans(tagger, texts) if tagger else [[] for _ in texts]):
        base = base_spans(text)
        starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        more, done = [], 0
        for a, b, kind in added:
            if a < done:  # in a run that is a secret already
                continue
            a, b = trimmed(text, a, b, kind)
            before = bisect_left(starts, b)
            if plausible(kind, text[a:b], text[max(0, a - 4) : a]) and not (before and ends[before - 1] > a):
                more.append((a, b, kind))
                done = b
        out.append((base, sorted(base + more, key=lambda s: (s[0], TAGS.index(s[2])))))
    return out


def labelled_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans to learn from: the patterns' and named secrets, without those that touch an earlier one."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted([*base_spans(text), *((m.start(1), m.end(1), "secret") for m in NAMED_SECRET.finditer(text))]):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def _disguised(kind: str, found: str, rng: np.random.Generator) -> str:
    """The same data as people write it when no pattern shall match."""
    pick = lambda *x: x[rng.integers(len(x))]
    if kind == "email":
        at, dot = pick((" at ", " dot "), (" at ", " dot "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", "."), (" @ ", " . "), (" (at) ", "."), ("[at]", "."), ("{at}", "{dot}"))
        # A name may have several parts, and so may a machine's.
        local, _, machine = found.partition("@")
        local, machine = pick(local, local.replace("_", ".").replace("-", "."), f"{local[:2]}.{local}"), pick(machine, f"{local[:4]}.{machine}")
        return f"{local}@{machine}".replace(".", dot).replace("@", at)
    if kind == "ip":
        return found.replace(".", pick(" . ", ". ", " ."))
    if kind == "card":
        digits = re.sub("[^0-9]", "", found)
        return pick(".", "/", "_", "  ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == "phone":
        return pick(found.lstrip("+"), found.replace("+", "00"), re.sub("[() -]+", ".", found).lstrip("+").strip("."))
    # A secret may be longer or shorter than those that are labelled.
    return pick(found, found, found + found[::-1], found[:20])


def disguised(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A labelled text in disguise, and where its spans then are. Of secrets the name changes or goes."""
    parts: list[str] = []
    spans, at, size = [], 0, 0
    for a, b, kind in labelled_spans(text):
        before = text[at:a]
        if kind == "secret":
            named = re.search(r"""\S+\s*[=:]\s*["']?$""", before)
            words = re.findall("[a-z]{3,9}", text)
            if named and words and rng.random() < 0.4:
                # Of letters alone, as words in a row or not; then its name must tell.
                names = ("password: ", "passwd=", "secret = '", "db_pass: \"", "token: ", "api_key=", "pwd = ", "SECRET=")
                before = before[: named.start()] + names[rng.integers(len(names))]
                new = "".join(words[rng.integers(len(words))] for _ in range(3 + rng.integers(4)))
                new = (new + new)[:16] if len(new) < 16 else new
                new = "".join(rng.permutation(list(new))) if rng.random() < 0.5 else new
            elif named:
                names = ("key: ", "bearer ", "access_key = ", "", "credential=", "pwd: '", '"session": "')
                before = before[: named.start()] + names[rng.integers(len(names))]
                new = _disguised(kind, text[a:b], rng)
            else:
                new = _disguised(kind, text[a:b], rng)
        else:
            new = _disguised(kind, text[a:b], rng)
        spans.append((size + len(before), size + len(before) + len(new), kind))
        parts += [before, new]
        size += len(before) + len(new)
        at = b
    return "".join([*parts, text[at:]]), spans


def training_set(texts: list[str], seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows with their tags, of each text and of its disguise. Digits have one code, so no number is learnt by heart."""
    rng = np.random.default_rng(seed)
    parts, marks = [], []
    for text in texts:
        spans = labelled_spans(text)
        for said, found in ((text, spans), disguised(text, rng)) if spans else ((text, spans),):
            tags = np.zeros(len(said), np.int64)
            for a, b, kind in found:
                tags[a:b] = 1 + TAGS.index(kind)
            for a, b in stretches(said):
                for start, part in windows(codes(said[a:b])):
                    parts.append(part)
                    marks.append(tags[a + start : a + start + len(part)])
    x, mask = _padded(parts)
    tags = np.zeros(x.shape, np.int64)
    for k, mark in enumerate(marks):
        tags[k, : len(mark)] = mark
    return x, tags, mask


_STRETCHES = pa.schema([("kind", pa.string()), ("h", pa.int64()), ("near", pa.string())])


def _labelled(parts: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Of each kind the stretches with the least hashes, whole words with what surrounds them; at most limit of a task."""
    held: dict[str, dict[int, str]] = {}
    for part in parts:
        for text in texts_of(part.column(0)):
            # What is read is longer than a stretch's surroundings only by whole words.
            for a, b in ((x, min(x + 4 * WINDOW, z)) for y, z in stretches(text) for x in range(y, z, 4 * WINDOW)):
                while a and not text[a - 1].isspace() and b - a < 4 * WINDOW:
                    a -= 1
                while b < len(text) and not text[b].isspace() and b - a < 8 * WINDOW:
                    b += 1
                near = text[a:b]
                found = labelled_spans(near)
                own = held.setdefault(found[0][2] if found else "none", {})
                h = xxhash.xxh3_64_intdigest(near.encode("utf-8", "replace")) >> 1
                if len(own) < limit or h < max(own):
                    own[h] = near
                    if len(own) > limit:
                        del own[max(own)]
    yield from batches(((kind, h, near) for kind, own in held.items() for h, near in own.items()), _STRETCHES)


def fit_tagger(docs: DataFrame, text: str = "text", labelled: int = LABELLED) -> Tagger | None:
    """A tagger from at most `labelled` different stretches of each kind, and of none, those with the smallest hashes; None without any stretch.

    The whole of all texts is looked through; only these stretches reach the driver, each of at most 8 windows. Null and
    empty texts have none; repeated ones count once.
    """
    bounded_batches(docs.sparkSession)
    found = checkpointed(docs.select(F.col(text)).mapInArrow(lambda parts: _labelled(parts, labelled), "kind string, h long, near string"))
    texts = []
    for kind in (*TAGS, "none"):
        texts += [r.near for r in found.where(F.col("kind") == kind).select("h", "near").distinct().orderBy("h", "near").limit(labelled).collect()]
    if not texts:
        return None
    tagger = Tagger.new()
    tagger.train(*training_set(texts))
    return tagger


def in_slices(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about size characters, one at least, so that a worker holds the windows of a run alone."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text)
    if some:
        yield some


def pii_column(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> Column:
    """struct<base, spans, masked>: the patterns' spans, all spans, and the text with each span as <KIND>.

    Null and empty texts have no spans, and a null text stays null. Spans are in code points, end exclusive, by start
    and then kind, secrets last. Very long texts are read whole. Equal texts and repeated rows get equal results, an empty
    table none. Only the text is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = "array<struct<kind: string, start: int, end: int>>"

    @F.pandas_udf(f"base {span}, spans {span}, masked string")
    def find(texts: pd.Series) -> pd.DataFrame:
        found = [x for some in in_slices([t or "" for t in texts]) for x in find_spans(shared.value, some)]
        give_back()
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]
        return pd.DataFrame({"base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found], "masked": [masked(t, s) for t, (_, s) in zip(texts, found)]})

    return find(F.col(text))


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans or text is None:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """docs with the struct column pii, as pii_column says; a column of that name gives way to it."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn("pii", pii_column(docs, tagger, text))


def spelled(spans: str) -> Column:
    """A column of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
