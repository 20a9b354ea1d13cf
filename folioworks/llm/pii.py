"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

The field labels words with O or B-/I- of a kind from word-shape features (shape, ends, digits, symbols, cue words, and
those of the neighbours). It is trained by maximum likelihood (forward-backward, Adam, L2) on a small labelled table of
(words, tags), by default pii_labelled.txt, sentences in four languages, and decoded by Viterbi in numpy batches.

Every word of every text goes through the field. A word's features depend on its shape only, so each distinct set of
features has one row of scores; words of letters alone, the great majority, find theirs without leaving numpy. A
stretch of words is decoded where some labels other than O could win: the sum of upper bounds of what each word can gain
by leaving O, over any stretch around it, decides; elsewhere the best path is O, so the result is that of decoding all.

Added spans must pass a check on their kind (card: 13 to 19 digits passing Luhn; ip: four parts up to 255; phone: 7 to
15 digits; email: a name, a host and an end in some spelling; secret: letters and digits mixed, 12 or more) and must not
touch a base span, which always stays. Secrets (keys, passwords) are no kind of personal data: they are told apart
from it, in columns of their own, and redacted like it.

Defined cases: null text is the empty text, without spans; repeated rows are searched each by itself; an empty table
gives an empty result; further columns are ignored by find and kept by redact, whatever their names. Texts of any
length are worked off whole, in batches of some MB or one text where that is longer. Offsets are code points, ends
exclusive. Of base matches of one kind none overlap; of different kinds they may.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioworks.llm.shared import hash_words, slices, small_batches, string_buffers, word_spans

KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in FOUND for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of the patterns of each kind, those that fail its test dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, done = text.find("@"), 0
    while at >= 0:
        start, host = at, _HOST.match(text, at + 1)
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < at:
            done = host.end()
            found["email"].append((start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# ---- the field -----------------------------------------------------------------------------------------------

CUES = frozenset(
    "at dot (at) [at] (dot) [dot] arroba (arroba) [arroba] arobase (arobase) ät [ät] punkt [punkt] punto [punto] point [point] phone tel telefon tél teléfono call fax mobile "
    "ring dial text email e-mail mail address contact kontakt ip host card visa amex karte carte tarjeta token key password".split()
)
_ITEM = re.compile(r"[A-Z]+|[a-z\u0080-\U0010ffff]+|[0-9]+|(.)\1*", re.S)
_TAILS = ".,;:!?"


def shape(word: str) -> list[str]:
    """Its runs: letters become A or a (which stands for all letters beyond ASCII), digits 9 and their number, other
    characters stay, once."""
    out = []
    for m in _ITEM.finditer(word):
        c = m[0][0]
        out.append(c if m[1] else "A" if c.isascii() and c.isupper() else f"9{min(len(m[0]), 20)}" if "0" <= c <= "9" else "a")
    return out


def cue(word: str) -> str:
    return word.rstrip(_TAILS).lower()


def own_features(word: str) -> list[str]:
    items, digits = shape(word), sum("0" <= c <= "9" for c in word)
    s = "".join(items) if len(items) <= 24 else "long"
    out = [f"s={s}", f"p={''.join(items[:2])}", f"q={''.join(items[-2:])}", f"d={min(digits, 20)}", f"k={''.join(sorted({c for c in items if not c[0].isalnum()}))}"]
    if digits:
        kinds = "".join(sorted({i[0] if i[0].isalnum() else "." for i in items}))
        out += [f"n={min(len(word) // 4, 12)}", f"m={min(sum(i in 'Aa' for i in items), 4)}", f"c={kinds}"]
    return [*out, f"w={cue(word)}"] if cue(word) in CUES else out


def features(words: Sequence[str]) -> list[list[str]]:
    own = [own_features(w) for w in words]
    pad = ["edge"]
    return [["1", *x, *(f"<{f}" for f in (own[i - 1] if i else pad)), *(f">{f}" for f in (own[i + 1] if i + 1 < len(own) else pad))] for i, x in enumerate(own)]


# Classes of bytes: letters (all bytes beyond ASCII count as small ones), digits, marks that end a word, others.
_SMALL, _CAPITAL, _TAIL, _OTHER = 1, 2, 4, 8
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[97:123] = _CLASS[128:] = _SMALL
_CLASS[65:91] = _CAPITAL
_CLASS[list(_TAILS.encode())] = _TAIL
_TAIL_AT = np.zeros(256, np.int64)
_TAIL_AT[list(_TAILS.encode())] = np.arange(1, len(_TAILS) + 1)
_PLAIN = [body + tail for body in ("ab", "AB", "Ab") for tail in ("", *_TAILS)]


class Field:
    """Weights of a linear-chain field over TAGS."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.index, self.emit, self.move, self.begin = index, emit, move, begin

        self._seen = {f.lstrip("<>") if f[:1] in "<>" else f for f in index}
        self._cues = np.sort(_hashes([*CUES]))
        self._begin_tables()
        legal = self.move > -1e3
        out = np.array([t[0] != "O" for t in TAGS])
        stay = self.move[0, 0]
        # most that entering, going on in, and leaving an entity can gain over O all along
        self._inside = float((self.move[np.ix_(out, out)] - stay)[legal[np.ix_(out, out)]].max())
        enter = max(float((self.move[:, i] - self.move[:, 0])[legal[:, i]].max()) for i in np.flatnonzero(out & (self.begin > -1e3)))
        enter = max(enter, float((self.begin[1:] - self.begin[0]).max()))
        leave = max(0.0, float((self.move[out][:, legal[0]] - self.move[0, legal[0]]).max()))
        self._edge = enter + leave - self._inside

    def _begin_tables(self) -> None:
        """Score rows of the edge and of words of letters alone; those of other words are added as they come."""
        self._row: dict[tuple, int] = {}
        self._known: dict[bytes, int] = {}
        # scores that a word of each feature set has itself, gives the word after it, and gives the word before it
        self.own, self.left, self.right = (np.zeros((0, len(TAGS))) for _ in range(3))
        self._waiting: list[tuple] = []
        self._take(("edge",))
        self._plain = np.array([self._take(self.features_of(w)) for w in _PLAIN])
        self._settle()

    def features_of(self, word: str) -> tuple[str, ...]:
        """Those of a word's features that have a weight."""
        return tuple(f for f in own_features(word) if f in self._seen)

    def _take(self, key: tuple) -> int:
        if key not in self._row:
            self._row[key] = len(self._row)
            self._waiting.append(key)
        return self._row[key]

    def _settle(self) -> None:
        """Score rows of feature sets that are new."""
        if not self._waiting:
            return
        sums = lambda mark, fs: self.emit[[self.index[mark + f] for f in fs if mark + f in self.index]].sum(0)
        bias = sums("", ["1"])
        self.own = np.concatenate([self.own, [sums("", key) + bias for key in self._waiting]])
        self.left = np.concatenate([self.left, [sums("<", key) for key in self._waiting]])
        self.right = np.concatenate([self.right, [sums(">", key) for key in self._waiting]])
        self._waiting = []
        self._gain = [np.maximum.reduce((x[:, 1:] - x[:, :1]), axis=1) for x in (self.own, self.left, self.right)]

    def rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The score rows of some words."""
        if not len(starts):
            return np.zeros(0, np.int64)
        kind = _CLASS[raw]
        last, tail = kind[ends - 1].copy(), raw[ends - 1]
        body = kind.copy()
        ended = (last == _TAIL) & (ends - starts > 1)
        body[ends[ended] - 1] = 0
        whole = np.bitwise_or.reduceat(body, starts)
        body[starts] = 0
        rest = np.bitwise_or.reduceat(body, starts)
        first = kind[starts]
        case = np.full(len(starts), -1)
        case[whole == _SMALL] = 0
        case[whole == _CAPITAL] = 1
        case[(first == _CAPITAL) & (rest == _SMALL)] = 2
        out = np.where(case >= 0, self._plain[np.maximum(case, 0) * (len(_TAILS) + 1) + np.where(ended, _TAIL_AT[tail], 0)], -1)
        h = hash_words(raw, starts, np.where(ended, ends - 1, ends))
        at = np.minimum(np.searchsorted(self._cues, h), len(self._cues) - 1)
        special = np.flatnonzero((out < 0) | (self._cues[at] == h))
        data = raw.tobytes()
        for i, a, b in zip(special.tolist(), starts[special].tolist(), ends[special].tolist(), strict=True):
            word = data[a:b]
            row = self._known.get(word)
            if row is None:
                row = self._known[word] = self._take(self.features_of(word.decode("utf-8", "replace")))
            out[i] = row
        self._settle()
        return out

    def decode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> list[tuple[int, int, int]]:
        """(kind, first word, one past its last word) of every entity on the best paths of some texts."""
        if len(self._known) > 200_000 or len(self._row) > 50_000:  # bounded; rows mean something within a call only
            self._begin_tables()
        n, texts = len(starts), len(before) - 1
        rows = np.zeros(n + texts + 1, np.int64)  # the edge stands before each text and after the last
        at = np.arange(n) + np.repeat(np.arange(texts), np.diff(before)) + 1
        rows[at] = self.rows(raw, starts, ends)
        gain = np.full(len(rows), -1e6)
        gain[at] = self._gain[0][rows[at]] + self._gain[1][rows[at - 1]] + self._gain[2][rows[at + 1]] + self._inside
        run = np.append(0.0, np.cumsum(gain))
        best = (run[1:] - np.minimum.accumulate(run[:-1])) + (np.maximum.accumulate(run[:0:-1])[::-1] - run[:-1]) - gain
        live = (best + self._edge >= -1e-3) & (rows > 0)
        windows = np.flatnonzero(np.diff(live.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        word = np.full(len(rows), -1)
        word[at] = np.arange(n)
        found = []
        for lo, tags in self._paths(rows, windows):
            j = 0
            while j < len(tags):
                e = j + 1
                if tags[j]:
                    while e < len(tags) and tags[e] == tags[j] + 1 and TAGS[tags[e]][0] == "I":
                        e += 1
                    found.append(((tags[j] - 1) // 2, int(word[lo + j]), int(word[lo + e - 1]) + 1))
                j = e
        return sorted(found, key=lambda x: x[1])

    def scores(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.own[rows[at]] + self.left[rows[at - 1]] + self.right[rows[at + 1]]

    def _paths(self, rows: np.ndarray, windows: np.ndarray, batch_words: int = 50_000) -> Iterator[tuple[int, list[int]]]:
        """Viterbi: (begin, best tags) of each window of places, which stand between words that are O or a text's edge;
        windows of like length go together."""
        width = windows[:, 1] - windows[:, 0]
        order = np.argsort(width, kind="stable")
        i = 0
        while i < len(order):
            j = max(i + 1, i + int(np.searchsorted(width[order[i:]] * np.arange(1, len(order) - i + 1), batch_words, "right")))
            part, i = windows[order[i:j]], j
            lengths, lo = part[:, 1] - part[:, 0], part[:, 0]
            yield from zip(lo.tolist(), self._viterbi(rows, lo, lengths), strict=True)

    def _viterbi(self, rows: np.ndarray, lo: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        n, longest, k = len(lo), int(lengths.max()), len(TAGS)
        best = np.where((rows[lo - 1] == 0)[:, None], self.begin, self.move[0]) + self.scores(rows, lo)
        back = np.zeros((longest, n, k), np.int8)
        for t in range(1, longest):
            alive = np.flatnonzero(t < lengths)
            step = best[alive, :, None] + self.move
            back[t] = np.arange(k, dtype=np.int8)
            back[t, alive] = step.argmax(1)
            best[alive] = step.max(1) + self.scores(rows, lo[alive] + t)
        best += np.where((rows[lo + lengths] == 0)[:, None], 0.0, self.move[:, 0])
        tag = best.argmax(1)
        path = np.empty((longest, n), np.int64)
        for t in range(longest - 1, -1, -1):
            path[t] = tag
            tag = back[t][np.arange(n), tag]
        return [path[:m, i].tolist() for i, m in enumerate(lengths.tolist())]


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    return hash_words(np.frombuffer(b" ".join(data), np.uint8), ends - [len(w) for w in data], ends)


def _legal() -> tuple[np.ndarray, np.ndarray]:
    """0 for permitted moves and beginnings, a large negative number for I- without its kind before it."""
    k = len(TAGS)
    move, begin = np.zeros((k, k)), np.zeros(k)
    for j, to in enumerate(TAGS):
        if to[0] == "I":
            begin[j] = -1e4
            for i, frm in enumerate(TAGS):
                if frm[1:] != to[1:]:
                    move[i, j] = -1e4
    return move, begin


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(labelled: Sequence[tuple[Sequence[str], Sequence[str]]], epochs: int = 120, rate: float = 0.1, l2: float = 1e-4) -> Field:
    """Maximum likelihood by full-batch Adam; the gradient is observed minus expected counts by forward-backward."""
    labelled = [(w, t) for w, t in labelled if len(w)]
    index: dict[str, int] = {}
    sent = [[[index.setdefault(f, len(index)) for f in fs] for fs in features(w)] for w, _ in labelled]
    n, longest, k = len(sent), max(map(len, sent), default=1), len(TAGS)
    lengths = np.array([len(s) for s in sent])
    y = np.zeros((n, longest), np.int64)
    for i, (_, tags) in enumerate(labelled):
        y[i, : len(tags)] = [TAGS.index(t) for t in tags]
    rows = np.array([i * longest + j for i, s in enumerate(sent) for j, fs in enumerate(s) for _ in fs])
    cols = np.array([f for s in sent for fs in s for f in fs])
    mask = np.arange(longest) < lengths[:, None]
    legal_move, legal_begin = _legal()
    params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(k)[y] * mask[:, :, None]
    gold_move = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, epochs + 1):
        emit = np.zeros((n * longest, k))
        np.add.at(emit, rows, params[0][cols])
        emit = emit.reshape(n, longest, k)
        move, begin = params[1] + legal_move, params[2] + legal_begin
        fwd, bwd = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        fwd[:, 0] = begin + emit[:, 0]
        for t in range(1, longest):
            new = _logsum(fwd[:, t - 1, :, None] + move, 1) + emit[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsum(move + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = _logsum(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pair = fwd[:, :-1, :, None] + move + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]
        pair = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        diff = (gold - node).reshape(n * longest, k)
        grad_emit = np.zeros_like(params[0])
        np.add.at(grad_emit, cols, diff[rows])
        grads = [grad_emit, gold_move - pair, (gold[:, 0] - node[:, 0]).sum(0)]
        for i, g in enumerate(grads):
            g = g / n - l2 * params[i]
            mean[i] = 0.9 * mean[i] + 0.1 * g
            var[i] = 0.999 * var[i] + 0.001 * g * g
            params[i] = params[i] + rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.999**step)) + 1e-8)
    return Field(index, params[0], params[1] + legal_move, params[2] + legal_begin)


_MARKED = re.compile(r"\{(" + "|".join(FOUND) + r"):([^{}]*)\}")


def labelled_rows() -> list[tuple[list[str], list[str]]]:
    """The rows of pii_labelled.txt, sentences with {kind:text} around what is to be found, as words and tags."""
    rows = []
    for line in Path(__file__).with_name("pii_labelled.txt").read_text(encoding="utf-8").splitlines():
        plain, marks, at = "", [], 0
        for m in _MARKED.finditer(line):
            plain += line[at : m.start()]
            marks.append((len(plain), len(plain) + len(m[2]), m[1]))
            plain, at = plain + m[2], m.end()
        plain += line[at:]
        words, tags, last = [], [], None
        for m in re.finditer(r"\S+", plain):
            mark = next((x for x in marks if x[0] < m.end() and m.start() < x[1]), None)
            words.append(m[0])
            tags.append("O" if mark is None else ("I-" if mark is last else "B-") + mark[2])
            last = mark
        rows.append((words, tags))
    return rows


def varied(rows: Sequence[tuple[Sequence[str], Sequence[str]]], times: int = 4, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The rows, and times - 1 more of those with secrets, which follow no spelling: letters and digits of their longer
    runs are drawn anew, each from those of its own run."""
    rng, out = np.random.default_rng(seed), [(list(w), list(t)) for w, t in rows]
    for _ in range(times - 1):
        for words, tags in rows:
            if not any(t[2:] == "secret" for t in tags):
                continue
            fresh = [re.sub(r"[A-Za-z0-9]{12,}", lambda m: "".join(rng.choice(list(m[0]), len(m[0]))), w) if t[2:] == "secret" else w for w, t in zip(words, tags, strict=True)]
            out.append((fresh, list(tags)))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """The small labelled table used where the caller has none: (words, tags). It goes to the JVM as an Arrow table; rows
    handed over as Python objects would be turned by Python workers of another kind, which stay beside those of the search."""
    words, tags = zip(*labelled_rows(), strict=True)
    kind = pa.list_(pa.string())
    return spark.createDataFrame(pa.table({"words": pa.array(words, kind), "tags": pa.array(tags, kind)}))


_TRIM = " \t\n\r\x0b\x0c.,;:!?\"'"
_PAIRS = {")": "(", "]": "[", ">": "<", "}": "{"}
_AT = r"\s*(?:@|[(\[<{]\s*(?:at|ät|arroba|arobase)\s*[)\]>}]|(?<=\s)(?:at|ät|arroba|arobase)(?=\s))\s*"
_DOT = r"\s*(?:\.|[(\[<{]\s*(?:dot|punkt|punto|point)\s*[)\]>}]|(?<=\s)(?:dot|punkt|punto|point)(?=\s))\s*"
_ADDRESS = re.compile(rf"[\w.%+-]+(?:{_DOT}[\w-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)


def _plausible(kind: str, text: str) -> bool:
    """Whether a span that the field has labelled can be of its kind."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 -]", text)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and (not re.search(r"[^0-9 ().+/-]", text)) and bool(re.search(r"[^0-9]", text.strip()))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text.split(":")[0])
        return len(parts) == 4 and all(int(p[:4]) <= 255 for p in parts)
    if kind == "secret":
        longest = max(re.findall(r"[A-Za-z0-9_+/-]+", text), key=len, default="")
        return len(longest) >= 12 and bool(re.search(r"[0-9]", longest)) and bool(re.search(r"[A-Za-z]", longest))
    return bool(_ADDRESS.fullmatch(text))


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without marks at its ends, and without brackets that are not its own."""
    while True:
        part = text[start:end]
        if part and (part[-1] in _TRIM or part[-1] in _PAIRS and _PAIRS[part[-1]] not in part):
            end -= 1
        elif part and (part[0] in _TRIM or part[0] in _PAIRS.values() and {v: k for k, v in _PAIRS.items()}[part[0]] not in part):
            start += 1
        elif len(part) > 1 and _PAIRS.get(part[-1]) == part[0] and part.count(part[0]) == 1:
            start, end = start + 1, end - 1
        else:
            return start, end


def added_spans(column, field: Field) -> dict[int, list[tuple[str, int, int]]]:
    """What the field finds in each text of a column, by the text's place: (kind, start, end) in code points."""
    raw, offsets = string_buffers(column)
    found: dict[int, list[tuple[str, int, int]]] = {}
    for i, j in slices(offsets, 1_000_000):
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, before = word_spans(part, own)
        for kind, a, b in field.decode(part, starts, ends, before):
            k = int(np.searchsorted(before, a, "right")) - 1
            text = part[own[k] : own[k + 1]]
            lo, hi = (int(np.count_nonzero((text[: x - own[k]] & 0xC0) != 0x80)) for x in (starts[a], ends[b - 1]))
            words = part[starts[a] : ends[b - 1]].tobytes().decode("utf-8", "replace")
            s, e = _trimmed(words, 0, len(words))
            if hi - lo == len(words) and _plausible(FOUND[kind], words[s:e]):
                found.setdefault(i + k, []).append((FOUND[kind], lo + s, lo + e))
    return found


def _search(column, field: Field) -> Iterator[tuple[int, dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """(row, base spans, added spans) of the rows that have some. Base patterns are tried on texts with an ASCII digit or
    an @, one of which is in every match; the field has seen all texts."""
    raw, offsets = string_buffers(column)
    added = added_spans(column, field)
    mark = np.zeros(256, bool)
    mark[48:58] = mark[64] = True
    at = np.flatnonzero(mark[raw])
    for i in sorted({*np.flatnonzero(np.diff(np.searchsorted(at, offsets))).tolist(), *added}):
        base = base_spans(raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        taken = [s for spans in base.values() for s in spans]
        yield i, base, [x for x in added.get(i, []) if all(x[2] <= a or x[1] >= b for a, b in taken)]


def _digest(base: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in base[k])


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def fitted(spark: SparkSession, labelled: DataFrame | None = None, max_rows: int = 5000) -> Field:
    """The field trained on the labelled table, of which at most max_rows rows, in the order of their words, count."""
    table = labelled if labelled is not None else labelled_table(spark)
    rows = table.where("size(words) > 0 and size(words) = size(tags)").orderBy("words", "tags").limit(max_rows).collect()
    return train(varied([(r["words"], r["tags"]) for r in rows]))


def find(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, numbers of base spans of each kind, their digest, all spans, how many the field
    has added, secrets (its spans of that kind) and their number, and n_found, all spans and secrets."""
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((7, n), np.int64)
            sha, spans, secrets = [EMPTY_SHA] * n, [""] * n, [""] * n
            for i, base, more in _search(batch.column(1), field.value):
                own = [x[1:] for x in more if x[0] == "secret"]
                counts[:4, i] = [len(base[k]) for k in KINDS]
                counts[4:, i] = len(more) - len(own), len(own), counts[:4, i].sum() + len(more)
                sha[i] = hashlib.sha256(_digest(base).encode()).hexdigest()
                spans[i] = _digest({k: sorted([*base[k], *[x[1:] for x in more if x[0] == k]]) for k in KINDS})
                secrets[i] = ",".join(f"secret:{a}:{b}" for a, b in own)
            arrays = [batch.column(0), *map(pa.array, counts[:4]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), *map(pa.array, counts[4:]), pa.array(secrets, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_found", "secrets"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_found long, secrets string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """docs with every span found replaced by its kind in angle brackets (overlapping spans by that of the first);
    all rows and columns stay, and n_chars, where there is such a column, follows the text."""
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(fitted(docs.sparkSession, labelled))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = None
            for i, base, more in _search(batch.column(at), field.value):
                spans = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, k) for k, a, b in more])
                if not spans:
                    continue
                texts = batch.column(at).to_pylist() if texts is None else texts
                out, done = [], 0
                for a, b, kind in spans:
                    if a >= done:
                        out += [texts[i][done:a], f"<{kind.upper()}>"]
                    done = max(done, b)
                texts[i] = "".join([*out, texts[i][done:]])
            if texts is not None:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    columns[j] = pa.array([None if t is None else len(t) for t in texts], columns[j].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
