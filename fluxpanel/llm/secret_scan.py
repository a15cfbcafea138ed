"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret.

Tokens are runs of letters, digits, ``+/_-`` and characters beyond ASCII. The field's features of a token are its shape (length and kinds of
characters, changes between them), the word before it, the characters before and after it, the shapes of its neighbours, and what kind of text the
whole text is. It is trained on windows of a bounded sample of texts in which the patterns' matches are the secrets; in a part of the windows the
match is written in another alphabet, or stands alone without its key word, so that the field learns to tell secrets that the patterns don't. Texts
are decoded by Viterbi. Plain words and numbers under sixteen characters are outside by rule, in the fit too, so that no path enters a secret there and
the best one is searched between them.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import bounded_sample, broadcast_value, written

# The patterns and the least lengths of their matches.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: In the order in which spans that start together are listed; the last one is the field's.
KINDS = ("assign", "access", "hex", "field")
#: What JVM-side sampling takes for a text that may have a match.
LIKELY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Texts with and texts without a likely match in the fit, windows of a text, characters of a window on each side of its centre, and its tokens.
SAMPLE, WINDOWS, REACH, TOKENS = 400, 2, 160, 48

VALUE = np.zeros(256, bool)
VALUE[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_-"), *range(128, 256)]] = True
DIGIT, UPPER, LOWER, SYMBOL, OTHER = range(5)
CLASS = np.full(256, SYMBOL, np.int8)
CLASS[48:58], CLASS[65:91], CLASS[97:123], CLASS[128:] = DIGIT, UPPER, LOWER, OTHER
HEXLOW = np.zeros(256, bool)
HEXLOW[[*range(48, 58), *range(97, 103)]] = True
#: One bit for each kind of byte between two tokens.
GAP = np.full(256, 32, np.uint8)
for _bit, _chars in enumerate((":=", "\"'`", " \t", "\n\r\x0b\x0c", ".")):
    GAP[[ord(_c) for _c in _chars]] = 1 << _bit
BARE = int(GAP[32])

#: Sizes of the feature tables: shape, changes, word before, bytes before, bytes after, kind before, kind after, text.
SIZES = (9 * 8, 8 * 8, 4096, 64, 64, 10, 10, 16)
BASE = np.concatenate([[0], np.cumsum(SIZES)])
#: Labels: begin, inside, outside; the scores of the last are 0.
B, I, O = range(3)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the patterns' matches, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def listed(spans: list[tuple]) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(spans))


class Tokens:
    """Tokens of many texts with what their features need."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.starts, self.ends, self.woff = K.split(data, at, ~VALUE)
        self.n = len(self.starts)
        kinds = CLASS[data]
        part = lambda flags: (lambda c: c[self.ends] - c[self.starts])(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)]))
        size = (self.ends - self.starts).astype(np.int32)
        digits, upper, lower, hexes = part(kinds == DIGIT), part(kinds == UPPER), part(kinds == LOWER), part(HEXLOW[data])
        other, letters = part(kinds == OTHER), upper + lower
        turn = np.zeros(len(data), bool)
        turn[1:] = kinds[1:] != kinds[:-1]
        first = turn[self.starts] if self.n else np.zeros(0, bool)
        turns = part(turn) - first
        # 0 lower, 1 capitalised, 2 upper, 3 digits, 4 hexadecimal with digits, 5 lower with digits, 6 other letters with digits, 7 mixed letters, 8 with other characters
        plain = size == letters
        kind = np.select(
            [other > 0, size == digits, plain & (upper == 0), plain & (lower == 0) & (upper > 1), plain & (upper == 1) & (turns <= 1), (hexes == size), (digits > 0) & (upper == 0), digits > 0, plain],
            [8, 3, 0, 2, 1, 4, 5, 6, 7], 8,
        )
        self.kind = kind.astype(np.int32)
        length = np.minimum(np.log2(np.maximum(size, 1)).astype(np.int32), 7)
        self.shape = self.kind * 8 + length
        self.change = np.minimum(turns, 7) * 8 + length
        self.size = size
        #: tokens that may be in a secret: letters mixed with digits or of both cases, or anything long
        self.open = ((self.kind >= 4) & (self.kind <= 7) & (size >= 4)) | (size >= 16)

    def texts_kind(self) -> np.ndarray:
        """What kind of text each text is, from 0 to 15: its share of characters that prose has few of, and of digits, in four steps each."""
        n = np.maximum(np.diff(self.at), 1)
        share = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[self.at]) / n
        steps = lambda x: np.searchsorted([0.005, 0.02, 0.08], x)
        odd = np.zeros(256, bool)
        odd[[ord(c) for c in "=:;{}[]()<>\"'`#$%&*|\\/_"]] = True
        digits = np.zeros(256, bool)
        digits[48:58] = True
        return steps(share(odd[self.data])) * 4 + steps(share(digits[self.data]))

    def gaps(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The kinds of bytes of each stretch between two places, of its last 32 bytes at most."""
        out = np.zeros(len(left), np.uint8)
        for back in range(1, 33):
            live = np.flatnonzero(right - back >= left)
            if not len(live):
                break
            out[live] |= GAP[self.data[right[live] - back]]
        return out.astype(np.int32)

    def features(self, idx: np.ndarray, text_kind: np.ndarray) -> np.ndarray:
        """Places in the weight table of each feature of the given tokens, in ascending order; ``text_kind`` has a number for each text."""
        doc = np.searchsorted(self.woff, idx, "right") - 1
        first, last = idx == self.woff[doc], idx == self.woff[doc + 1] - 1
        before, after = np.maximum(idx - 1, 0), np.minimum(idx + 1, max(self.n - 1, 0))
        uniq, inverse = np.unique(before, return_inverse=True)
        word = K.span_hashes(self.data, self.starts[uniq], self.ends[uniq], lower=True)[inverse] % K.U64(SIZES[2] - 1)
        left = np.where(first, self.at[doc], self.ends[before] if self.n else 0)
        right = np.where(last, self.at[doc + 1], self.starts[after] if self.n else 0)
        ahead = np.minimum(right, self.ends[idx] + 32)
        cols = [
            self.shape[idx], self.change[idx], np.where(first, SIZES[2] - 1, word.astype(np.int64)), self.gaps(left, self.starts[idx]), self.gaps(self.ends[idx], ahead),
            np.where(first, 9, self.kind[before]), np.where(last, 9, self.kind[after]), text_kind[doc],
        ]
        return np.column_stack(cols).astype(np.int64) + BASE[:-1]


def disguised(text: str, rnd: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The text with each secret written in a random alphabet and length, and where they are then."""
    alphabets = ["0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"]
    out, spans, done = [], [], 0
    for s, _, e, inner in base_spans(text):
        if inner < done:
            continue
        new = "".join(rnd.choices(rnd.choice(alphabets), k=rnd.randrange(16, 49)))
        out += [text[done:inner], new]
        begin = sum(map(len, out)) - len(new)
        spans.append((begin, begin + len(new)))
        done = e
    return "".join(out) + text[done:], spans


def examples(windows: list[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, which tokens are open) of windows, TOKENS places each; places after a window's end have label -1.

    Each window is taken as it is; one with secrets is taken again with them disguised, and twice more with the secrets also bare, between spaces
    and after no known word.
    """
    rnd = random.Random(seed)
    feats, labels, opens = [], [], []
    for text, kind in sorted(windows):
        spans = [(inner, e) for _, _, e, inner in base_spans(text)]
        for version in range(4 if spans else 1):
            t, sp = disguised(text, rnd) if version else (text, spans)
            raw = t.encode("utf-8", "surrogatepass")
            data = np.frombuffer(raw, np.uint8)
            tok = Tokens(data, np.array([0, len(raw)]))
            if not tok.n:
                continue
            point = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
            s, e = point[tok.starts] - 1, point[tok.ends - 1]
            y = np.full(tok.n, O)
            for a, b in sp:
                inside = np.flatnonzero(tok.open & (2 * (np.minimum(e, b) - np.maximum(s, a)) >= e - s))
                inside = inside[: int((np.diff(inside) == 1).argmin()) + 1] if (np.diff(inside) > 1).any() else inside  # up to a gap
                y[inside] = I
                y[inside[:1]] = B
            centre = int(np.flatnonzero(y == B)[0]) if (y == B).any() else tok.n // 2
            i = max(min(centre - TOKENS // 2, tok.n - TOKENS), 0)
            x = tok.features(np.arange(tok.n), np.array([kind]))[i : i + TOKENS]
            y = y[i : i + TOKENS]
            if version >= 2:
                x[y != O, 2] = BASE[2] + SIZES[2] - 1
                x[y != O, 3], x[y != O, 4] = BASE[3] + BARE, BASE[4] + BARE
            opens.append(np.pad(tok.open[i : i + TOKENS], (0, TOKENS - len(x))))
            feats.append(np.pad(x, ((0, TOKENS - len(x)), (0, 0)), constant_values=BASE[-1]))
            labels.append(np.pad(y, (0, TOKENS - len(y)), constant_values=-1))
    if not feats:
        return np.zeros((0, TOKENS, len(SIZES)), np.int64), np.zeros((0, TOKENS), np.int64), np.zeros((0, TOKENS), bool)
    return np.array(feats), np.array(labels), np.array(opens)


#: Score of what cannot be.
NEVER = -1e6
#: Transitions that there are not: inside after outside.
FORBIDDEN = np.zeros((3, 3), bool)
FORBIDDEN[O, I] = True


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def posteriors(e: np.ndarray, t: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log partition, label posteriors, sums of transition posteriors) by forward and backward sums.

    e: (sequences, places, 3) scores; ``live`` says which places there are. Each sequence stands between two outside tokens.
    """
    n, length, _ = e.shape
    fore, back = np.zeros((n, length + 1, 3)), np.zeros((n, length + 1, 3))
    start = np.full(3, -1e30)
    start[O] = 0.0
    fore[:, 0] = start
    for k in range(length):
        step = _lse(fore[:, k, :, None] + t, 1) + e[:, k]
        fore[:, k + 1] = np.where(live[:, k, None], step, fore[:, k])
    back[:, length] = t[:, O]
    for k in range(length - 1, -1, -1):
        step = _lse(t + (e[:, k] + back[:, k + 1])[:, None, :], 2)
        back[:, k] = np.where(live[:, k, None], step, back[:, k + 1])
    z = _lse(fore[:, length] + t[:, O], 1)
    label = np.exp(fore[:, 1:] + back[:, 1:] - z[:, None, None]) * live[:, :, None]
    pair = np.zeros((3, 3))
    for k in range(length):
        pair += np.exp(fore[:, k, :, None] + t + (e[:, k] + back[:, k + 1])[:, None, :] - z[:, None, None])[live[:, k]].sum(0)
    pair[:, O] += np.exp(fore[:, length] + t[:, O] - z[:, None]).sum(0)
    return z, label, pair


def fit_field(x: np.ndarray, y: np.ndarray, open_: np.ndarray, rounds: int = 80, rate: float = 0.15, penalty: float = 0.5) -> dict[str, np.ndarray]:
    """Weights (features, 2) for begin and inside, and transitions, by the penalised likelihood; without secrets, a field that finds none."""
    size = int(BASE[-1]) + 1
    w, t = np.zeros((size, 2)), np.where(FORBIDDEN, NEVER, 0.0)
    if not (y == B).any():
        return {"w": w, "t": t, "empty": np.array(True)}
    live = y >= 0
    hot = np.zeros((*y.shape, 3))
    for label in range(3):
        hot[:, :, label] = y == label
    open_ = open_ & live
    x = x[open_]  # features of the other tokens play no part
    count = lambda p, labels=(B, I): np.column_stack([np.bincount(x.ravel(), np.repeat(p[open_][:, c], x.shape[1]), size) for c in labels])
    seen, outside = count(hot), count(hot, (O,))[:, 0]
    w[: BASE[1]] = np.clip(np.log((seen + 0.1) / (outside[:, None] + 0.1)), -8, 8)[: BASE[1]]  # start: each shape's share
    pairs = np.zeros((3, 3))
    for row in y:
        path = [O, *row[row >= 0].tolist(), O]
        np.add.at(pairs, (path[:-1], path[1:]), 1)
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for k in range(1, rounds + 1):
        e = np.zeros((*y.shape, 3))
        e[:, :, :2] = NEVER
        e[open_, :2] = w[x].sum(1)
        _, label, pair = posteriors(e, t, live)
        gw, gt = count(label) - seen + penalty * w, pair - pairs + penalty * np.where(FORBIDDEN, 0, t)
        for g, m, v in ((gw, mw, vw), (gt, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.05 * (g * g - v)
        step = rate / (1 + k / 40)
        w -= step * (mw / (1 - 0.9**k)) / (np.sqrt(vw / (1 - 0.95**k)) + 1e-6)
        t -= np.where(FORBIDDEN, 0, step * (mt / (1 - 0.9**k)) / (np.sqrt(vt / (1 - 0.95**k)) + 1e-6))
    w[-1] = 0
    return {"w": w, "t": t, "empty": np.array(False)}


def viterbi(e: list[list[float]], t: list[list[float]]) -> list[int]:
    """The labels of the best path between two outside tokens; of equal ones, that of the smaller labels from the end."""
    best, back = [t[O][y] + e[0][y] for y in range(3)], []
    for scores in e[1:]:
        each = [max((best[p] + t[p][y], -p) for p in range(3)) for y in range(3)]
        back.append([-p for _, p in each])
        best = [v + s for (v, _), s in zip(each, scores, strict=True)]
    path = [-max((best[p] + t[p][O], -p) for p in range(3))[1]]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


class Field:
    """A trained field, ready for decoding."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.w, self.t, self.empty = model["w"], model["t"], bool(model["empty"])

    def labels(self, tok: Tokens, text_kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, labels) of all tokens that are not outside on the best path."""
        open_ = np.flatnonzero(tok.open)
        if self.empty or not len(open_):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = np.zeros((len(open_), 3))
        for i in range(0, len(open_), 1 << 17):
            e[i : i + (1 << 17), :2] = self.w[tok.features(open_[i : i + (1 << 17)], text_kind)].sum(1)
        doc = np.searchsorted(tok.woff, open_, "right") - 1
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc) > 0)) + 1
        begin, end = np.concatenate([[0], cut]), np.append(cut, len(open_))
        # a run of one token needs no search
        some = (end - begin > 1) | (e[begin, B] + self.t[O, B] + self.t[B, O] >= 2 * self.t[O, O])
        found, labels, t = [], [], self.t.tolist()
        for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True):
            for k, y in enumerate(viterbi(e[i:j].tolist(), t)):
                if y != O:
                    found.append(int(open_[i + k]))
                    labels.append(y)
        return np.array(found, np.int64), np.array(labels, np.int64)


def scan(col: pa.Array, field: Field) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """(base spans, added spans) of each text, in code points."""
    col = K.texts(col)
    base: list[list[tuple]] = [[] for _ in range(len(col))]
    more: list[list[tuple]] = [[] for _ in range(len(col))]
    for i, n, data, at in K.slices(col):
        if not len(data):
            continue
        tok = Tokens(data, at)
        upto = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])  # colons and equal signs
        likely = np.diff(upto[at]) > 0
        likely[np.searchsorted(tok.woff, np.flatnonzero(tok.size >= LEAST_ACCESS), "right") - 1] = True
        for d in np.flatnonzero(likely).tolist():
            base[i + d] = base_spans(data[at[d] : at[d + 1]].tobytes().decode("utf-8"))
        found, labels = field.labels(tok, tok.texts_kind()) if not field.empty else ([], [])
        if not len(found):
            continue
        doc = np.searchsorted(tok.woff, found, "right") - 1
        k = 0
        while k < len(found):
            j = k + 1
            while j < len(found) and labels[j] == I and found[j] == found[j - 1] + 1 and doc[j] == doc[k]:
                j += 1
            d = int(doc[k])
            s, e = int(tok.starts[found[k]]), int(tok.ends[found[j - 1]])
            while e < at[d + 1] and e < tok.ends[found[j - 1]] + 2 and data[e] == 61:  # padding
                e += 1
            more[i + d].append((s - int(at[d]), e - int(at[d])))
            k = j
        for d in np.unique(doc).tolist():
            point = np.concatenate([[0], np.cumsum((data[at[d] : at[d + 1]] & 0xC0) != 0x80)])
            spans = [(int(point[s]), int(point[e])) for s, e in more[i + d]]
            taken = sorted((s, e) for s, _, e, _ in base[i + d])
            more[i + d] = [(s, 3, e) for s, e in spans if not _overlaps(taken, s, e)]
    return base, more


def _overlaps(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    return any(a < e and s < b for a, b in taken)


def windows_of(text: str, kind: int, seed: int) -> list[tuple[str, int]]:
    """Stretches of a text for the fit: around its secrets, or else around a token with digits and at a random place."""
    rnd = random.Random(seed)
    spans = base_spans(text)
    if spans:
        chosen = spans if len(spans) <= WINDOWS else rnd.sample(spans, WINDOWS)
        at = [(inner, min(e, inner + REACH)) for _, _, e, inner in chosen]
    else:
        digits = [m.start() for m in re.finditer(r"\b[A-Za-z]*[0-9][A-Za-z0-9]{5,}", text)]
        at = [(p, p) for p in ([rnd.choice(digits)] if digits else []) + [rnd.randrange(max(len(text), 1))]]
    return [(text[max(s - REACH, 0) : e + REACH], kind) for s, e in at]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A field fitted on windows of ``sample`` distinct texts that may have a match and as many that don't, those of the smallest hashes.

    Null and empty texts have no part; copies count once. Without any match the field finds nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text <> ''").withColumn("h", F.xxhash64("text"))
    kinds = written(rows.select("h", F.col("text").rlike(LIKELY).alias("likely")).groupBy("h").agg(F.max("likely").alias("likely")), "secret-kinds")
    sizes = {r["likely"]: r["n"] for r in kinds.groupBy("likely").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [bounded_sample(kinds.filter(F.col("likely") == flag).select("h"), sample, F.col("h"), sizes.get(flag, 0)) for flag in (True, False)]
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows of 8 bytes at most

    def cut(batches):
        for b in batches:
            kind = np.zeros(0)
            for i, n, data, at in K.slices(K.texts(b.column("text"))):
                kind = Tokens(data, at).texts_kind()
                for d in range(n):
                    text = data[at[d] : at[d + 1]].tobytes().decode("utf-8")
                    found = windows_of(text, int(kind[d]), int(b.column("h")[i + d].as_py()) & 0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found]), pa.array([k for _, k in found], pa.int32())], ["window", "kind"])

    texts = rows.join(F.broadcast(chosen), "h", "left_semi")
    got = texts.groupBy("h").agg(F.any_value("text").alias("text")).select("text", "h").mapInArrow(cut, "window string, kind int").collect()  # WINDOWS for each text at most
    return fit_field(*examples([(r["window"], r["kind"]) for r in got]))


def find_secrets(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every row.

    spans lists all spans as kind:start:end (code points, end exclusive), base_sha256 is the digest of those of the patterns. The field's spans
    that overlap one of a pattern are left out. A null text is an empty one and has none. Texts are read whole, however long; repeated rows
    and rows with a null id are scanned like others, ties (spans that start together) are listed by kind. Columns other than the two named are
    not read, whatever their names. An empty table gives no rows.
    """
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches):
        field = Field(shared.value)
        for b in batches:
            base, more = scan(b.column("text"), field)
            count = lambda k: pa.array([sum(x[1] == k for x in each) for each in base], pa.int64())  # noqa: B023, E731
            digest = [hashlib.sha256(listed(x).encode()).hexdigest() for x in base]
            spans = [listed([*x, *y]) for x, y in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), count(0), count(1), count(2), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array([len(x) for x in more], pa.int64())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return narrow.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint").withColumnRenamed("id", id_col)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Fits the field on the texts themselves and scans every row; see ``train`` and ``find_secrets``."""
    return find_secrets(docs, train(docs, text_col, sample), id_col, text_col)
