"""Language of documents and of their segments.

A sparse multinomial logistic regression over TF-IDF of character n-grams (inside words, with their edges), trained
by follow-the-regularised-leader with an elastic net on a bounded, balanced sample of labelled documents, then
calibrated by one temperature on held-out blocks. Labels are dirty, so after a first round blocks that contradict
their label are left out and the model is trained anew.

Document frequencies are those of the whole corpus, counted in a pass of their own.

A text is scored by units: its lines, long ones cut at ends of sentences (else at blanks, else anywhere). The score of
a unit is a sum over its words, and the vector of a word is computed once per worker, so the cost of a corpus is that
of cutting it into words. Comments, headings, fences and blank lines say nothing; a comment between /* and */ goes over
all its lines, and an asterisk outside one is a list's. The best sequence of languages over the units of a document,
with a cost for every change, gives segments; a short one between two of one language belongs to these. All texts are
read whole.

Two temperatures: a sharp one, from held-out blocks that the model and their label agree on, weighs units against the
cost of a change; the confidence that comes out uses another, fitted to all held-out blocks together with the share of
wrong labels among them, so that it is the probability of the language and not of a dirty label.

Defined results: null, empty and blank texts, and texts of nothing but comments and symbols, have no segment. Ties go
to the language first in order. Unknown labels and blank labels teach nothing. Without any labelled document nothing
can be learned: ValueError.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identity import entity_key
from .pretokens import LETTER, OTHER, Batch, Words, portions, split


@dataclass(frozen=True)
class Rule:
    sample_per_language: int = 120  # bound of the training sample: documents of each language
    bits: int = 15  # of the hashed n-grams
    longest_gram: int = 4
    sample_chars: int = 200_000  # documents longer than this aren't in the sample; they are read like all others
    unit_chars: int = 240  # lines of more than twice this are cut
    block_chars: int = 240  # of a training example
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.001
    batch: int = 32
    rounds: int = 2
    cleanings: int = 2
    most_wrong: float = 0.35  # but never more than this part of a language's blocks
    least_steps: int = 800  # small samples are gone through more often
    doubt: float = 0.5  # blocks whose label gets no more than this from the first model are left out
    change: float = 5.0  # cost of a change of language, in nats
    change_at_seam: float = 1.0  # the same at a fence, rule or tag
    chars_per_nat: float = 25.0  # a line can speak against a language by at most its length over this
    block: int = 300  # least characters of a block


def grams(words: list[bytes], longest: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words, one word after the other, and how many each has: the word itself, then the n-grams of
    its lower case with its edges. Array operations over all words at once."""
    texts = [w.decode("utf-8", "replace").lstrip(" ") for w in words]
    edged = [f"^{t.lower()}$" for t in texts]
    cp = np.frombuffer("".join(edged).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, edged), np.int64, len(edged))
    start = np.cumsum(size) - size
    each = [np.maximum(size - n + 1, 0) for n in range(2, longest + 1)]
    count = 1 + sum(each, np.zeros(len(edged), np.int64))
    at = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    out[at] = np.fromiter((zlib.crc32(b"w" + t.encode()) & mask for t in texts), np.int64, len(texts))
    at = at + 1
    word = np.repeat(np.arange(len(edged)), size)
    place = np.arange(len(cp)) - start[word]
    h = cp
    for n, of in zip(range(2, longest + 1), each):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :] if len(cp) >= n else h[:0]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        inside = np.flatnonzero(place[: len(h)] < of[word[: len(h)]])
        out[at[word[inside]] + place[inside]] = ((mixed[inside] >> np.uint64(33)) & np.uint64(mask)).astype(np.int64)
        at = at + of
    return out, count


#: Tags between which another language stands in HTML.
TAGS = re.compile(rb"</?(?:script|style)\b[^>]*>", re.I)


@dataclass
class Lines:
    """Units of texts: lines, or parts of long lines."""

    text: np.ndarray  # number of the text of each unit
    line: np.ndarray  # number of the line, over all texts
    start: np.ndarray  # first byte
    stop: np.ndarray
    chars: np.ndarray  # characters up to the first byte of each unit, and up to its end
    ends: np.ndarray
    silent: np.ndarray  # comment, heading, fence or blank
    seam: np.ndarray  # a fence, rule or tag between blocks: the language may change here


def _parts(data: np.ndarray, start: int, stop: int, unit: int) -> list[int]:
    """Where a long line is cut, after about `unit` bytes each time: at the end of a sentence, else at a blank, else
    between two characters."""
    line = data[start:stop]
    blank = np.flatnonzero(line[:-1] == 32) + 1
    ends = blank[(blank > 1) & np.isin(line[np.maximum(blank - 2, 0)], np.frombuffer(b".!?;:", np.uint8))]
    out, at = [], 0
    while len(line) - at > 2 * unit:
        cut = 0
        for places in (ends, blank):
            i = np.searchsorted(places, at + unit)
            if i < len(places) and places[i] <= at + 2 * unit:
                cut = int(places[i])
                break
        if not cut:
            cut = at + unit
            while line[cut] & 0xC0 == 0x80:
                cut += 1
        out.append(start + cut)
        at = cut
    return out


def _commented(b: Batch, start: np.ndarray, stop: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Lines of comments between /* and */, where the opening stands at the start of a line, or behind code with a line
    that starts with an asterisk after it. An opening that is never closed in its text is none."""
    data = b.data
    n = len(data) - 8
    opens = np.flatnonzero((data[:n] == 47) & (data[1 : n + 1] == 42))
    silent = np.zeros(len(start) + 1, np.int64)
    if not len(opens):
        return silent[:-1].astype(bool)
    closes = np.flatnonzero((data[:n] == 42) & (data[1 : n + 1] == 47))
    line = np.searchsorted(start, opens, side="right") - 1
    after = np.searchsorted(closes, opens + 2)
    has = after < len(closes)
    opens, line, close = opens[has], line[has], closes[after[has]] if len(closes) else closes
    upto = np.searchsorted(start, close, side="right") - 1
    follows = np.minimum(line + 1, len(start) - 1)
    starred = (data[np.minimum(first[follows], n)] == 42) & ((data[np.maximum(opens - 1, 0)] == 32) | (data[np.maximum(opens - 1, 0)] == 9))
    leads = opens == first[line]
    ok = (upto > line) & (text[upto] == text[line]) & (leads | starred)
    np.add.at(silent, line[ok] + ~leads[ok], 1)
    np.add.at(silent, upto[ok] + 1, -1)
    return np.cumsum(silent[:-1]) > 0


def lines_of(b: Batch, unit: int = Rule.unit_chars) -> Lines:
    data = b.data[:-8]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[b.text_at] = True
    start = np.flatnonzero(cut[:n])
    if not len(start):
        z = np.zeros(0, np.int64)
        return Lines(z, z, z, z, z, z, z.astype(bool), z.astype(bool))
    stop = np.r_[start[1:], n]
    upto = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    ink = np.flatnonzero(data > 32)
    at = np.searchsorted(ink, start)
    first = np.where(at < len(ink), ink[np.minimum(at, max(len(ink) - 1, 0))] if len(ink) else n, n)
    # a byte order mark before the first word
    bom = (b.data[np.minimum(first, n)] == 0xEF) & (b.data[np.minimum(first + 1, n)] == 0xBB) & (b.data[np.minimum(first + 2, n)] == 0xBF)
    first = np.where(bom & (first < stop), first + 3, first)
    blank = first >= stop
    text = np.searchsorted(b.text_at, start, side="right") - 1
    c = [b.data[np.minimum(first + j, n)] for j in range(4)]
    is_ = lambda j, ch: c[j] == ord(ch)
    silent = blank | (is_(0, "/") & (is_(1, "/") | is_(1, "*"))) | (is_(0, "*") & is_(1, "/")) | _commented(b, start, stop, first, text)
    silent |= is_(0, "#") & ((c[1] <= 32) | is_(1, "#") | is_(1, "!"))
    silent |= is_(0, "-") & is_(1, "-") & ((c[2] <= 32) | is_(2, "-"))
    silent |= is_(0, "<") & is_(1, "!") & is_(2, "-")
    seam = is_(0, "-") & is_(1, "-") & is_(2, "-") | (is_(0, "#") & is_(1, " ") & is_(2, "-") & is_(3, "-"))
    for f in "`~'\"=":
        seam |= is_(0, f) & is_(1, f) & is_(2, f)
    for m in TAGS.finditer(b.data.tobytes()):
        i = np.searchsorted(start, m.start(), side="right") - 1
        seam[i] = True
        silent[i] |= first[i] == m.start()
    silent |= seam & ~blank & (is_(0, "-") | is_(0, "#") | is_(0, "`") | is_(0, "~") | is_(0, "'") | is_(0, '"') | is_(0, "="))
    seam &= ~blank
    line = np.arange(len(start))
    long = np.flatnonzero((stop - start > 2 * unit) & ~silent)
    if len(long):
        more = [_parts(data, int(start[i]), int(stop[i]), unit) for i in long]
        where = np.repeat(long, [len(m) for m in more])
        begin = np.r_[start, np.fromiter((x for m in more for x in m), np.int64)]
        order = np.argsort(begin, kind="stable")
        start, line = begin[order], np.r_[line, where][order]
        whole = order < len(stop)
        stop, silent, seam, text = np.r_[start[1:], n], silent[line], seam[line] & whole, text[line]
    return Lines(text, line, start, stop, upto[start], upto[stop], silent, seam)


def _spoken(b: Batch) -> np.ndarray:
    return np.flatnonzero((b.kind == LETTER) | (b.kind == OTHER))


class Model:
    """Weights of the n-grams that have any, IDF, bias, the temperatures of the path and of the confidence, and the
    share of wrong labels that the fit of the latter found."""

    def __init__(self, names, rule: Rule, weights: np.ndarray, idf: np.ndarray, bias: np.ndarray, temperature: float, calibration: tuple[float, float] = (1.0, 0.0), noise: float = 0.0, unit: float = 1.0):
        self.names, self.rule, self.bias, self.temperature = list(names), rule, bias.astype(np.float32), temperature
        self.calibration, self.noise, self.unit = calibration, noise, unit  # unit: the squared norm of a usual block
        self.rows = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
        self.weights, self.idf = weights[self.rows].astype(np.float32), idf.astype(np.float32)

    def table(self) -> np.ndarray:
        """Dense weights times IDF, and the square of the IDF in the last column."""
        t = np.zeros((len(self.idf), len(self.names) + 1), np.float32)
        t[self.rows, :-1] = self.weights * self.idf[self.rows, None]
        t[:, -1] = self.idf**2
        return t

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-9)) + self.bias

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Log-probabilities from sums of word vectors, for the path."""
        z = self.logits(sums) / self.temperature
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def confidences(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities: a longer text gives surer logits, by the growth that held-out texts show."""
        c, growth = self.calibration
        z = self.logits(sums) * (np.maximum(sums[:, -1:], 1e-9) / self.unit) ** growth / c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class _Ftrl:
    """Follow-the-regularised-leader, per coordinate, for a softmax."""

    def __init__(self, rows: int, k: int, rule: Rule):
        self.z, self.n, self.r = np.zeros((rows, k), np.float32), np.zeros((rows, k), np.float32), rule
        self.bz, self.bn = np.zeros(k), np.zeros(k)

    def _w(self, z, n, l1):
        w = -(z - np.sign(z) * l1) / ((self.r.beta + np.sqrt(n)) / self.r.alpha + self.r.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def weights(self, u=slice(None)):
        return self._w(self.z[u], self.n[u], self.r.l1)

    def bias(self):
        return self._w(self.bz, self.bn, 0.0)

    def step(self, x: np.ndarray, u: np.ndarray, y: np.ndarray, weight: np.ndarray):
        w, b = self.weights(u), self.bias()
        s = x @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[y][:, None]
        g = x.T @ p.astype(np.float32)
        n = self.n[u]
        more = n + g * g
        self.z[u] += g - (np.sqrt(more) - np.sqrt(n)) / np.float32(self.r.alpha) * w.astype(np.float32)
        self.n[u] = more
        g = p.sum(axis=0)
        self.bz += g - (np.sqrt(self.bn + g * g) - np.sqrt(self.bn)) / self.r.alpha * b
        self.bn += g * g


def calibrated(s: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(temperature, growth, share of wrong labels) that explain the labels of held-out logits best: the logits count
    for length ** growth / temperature, and a label is the true one, or, with that share, any of the others."""
    best, found, k = np.inf, (1.0, 0.0, 0.0), s.shape[1]
    if len(y) < 20 or k < 2:
        return found
    s = s - s.max(axis=1, keepdims=True)
    for growth in (0.0, 0.1, 0.2, 0.3, 0.4, 0.5):
        longer = (length**growth)[:, None]
        for c in np.geomspace(0.02, 5, 60):
            z = s * longer / c
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e[np.arange(len(y)), y] / e.sum(axis=1)
            for noise in (0.0, 0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4):
                loss = -np.log((1 - noise) * p + noise / (k - 1) * (1 - p) + 1e-12).mean()
                if loss < best:
                    best, found = loss, (float(c), growth, noise)
    return found


def train(texts: list[str], labels: list[int], names: list[str], rule: Rule = Rule(), frequency: tuple[int, np.ndarray] | None = None) -> Model:
    """frequency: the number of documents of the corpus and of those that hold each n-gram; without it the texts are
    the corpus."""
    size, k = 1 << rule.bits, len(names)
    y_of = np.asarray(labels)
    b = split(texts)
    ln = lines_of(b, rule.unit_chars)
    words = Words()
    at = _spoken(b)
    number = words.number(b, at)
    line = np.searchsorted(ln.start, b.start[at], side="right") - 1
    loud = ~ln.silent[line]
    number, line = number[loud], line[loud]
    # blocks: consecutive lines of a text, about block_chars together
    spoken = np.where(ln.silent, 0, ln.ends - ln.chars)
    upto = np.cumsum(spoken) - spoken
    first = np.searchsorted(ln.text, np.arange(len(texts)))
    part = (upto - upto[np.minimum(first, len(upto) - 1)][ln.text]) // rule.block_chars if len(upto) else upto
    _, block_of_line = np.unique(ln.text * (1 << 32) + part, return_inverse=True)
    text_of_block = np.zeros(block_of_line.max() + 1, np.int64)
    text_of_block[block_of_line] = ln.text
    block = block_of_line[line]
    flat, count = grams(words.values, rule.longest_gram, size - 1)
    flat, offset = flat.astype(np.int32), np.cumsum(count) - count
    order = np.argsort(block, kind="stable")
    block, number = block[order], number[order]
    reps = count[number]
    pos = np.cumsum(reps) - reps
    feature = flat[np.repeat(offset[number] - pos, reps) + np.arange(reps.sum())]
    edge = np.r_[0, np.cumsum(np.bincount(block, weights=reps, minlength=len(text_of_block)))].astype(np.int64)
    if frequency is None:
        frequency = len(texts), _frequencies(b, ln, words, flat, count, size)
    idf = (np.log((1 + frequency[0]) / (1 + frequency[1])) + 1).astype(np.float32)
    square = np.r_[0, np.cumsum(idf[feature] ** 2, dtype=np.float64)]
    norm = np.sqrt(np.maximum(square[edge[1:]] - square[edge[:-1]], 1e-12))
    del square
    y = y_of[text_of_block]
    usable = np.flatnonzero(np.diff(edge) > 0)
    held = (text_of_block[usable] * 2654435761 % 997) % 5 == 0
    fit, out = usable[~held], usable[held]

    def dense(rows):
        f = np.concatenate([feature[edge[r] : edge[r + 1]] for r in rows])
        o = np.repeat(np.arange(len(rows)), edge[rows + 1] - edge[rows])
        u, inv = np.unique(f, return_inverse=True)
        x = np.bincount(o * len(u) + inv, weights=idf[f] / norm[rows][o], minlength=len(rows) * len(u)).reshape(len(rows), len(u))
        return x.astype(np.float32), u

    def learn(rows, rounds):
        m, rng = _Ftrl(size, k, rule), np.random.default_rng(7)
        there = np.bincount(y[rows], minlength=k)
        weight = np.clip(there.max() / np.maximum(there, 1), 1, 5)  # languages with few blocks count for more
        for _ in range(max(rounds, -(-rule.least_steps * rule.batch // max(1, len(rows))))):
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // rule.batch)):
                x, u = dense(part)
                m.step(x, u, y[part], weight)
        return m

    def logits(m, rows):
        w, bias = m.weights(), m.bias()
        s = []
        for part in np.array_split(rows, max(1, len(rows) // 512)):
            if len(part):
                x, u = dense(part)
                s.append(x @ w[u] + bias)
        return np.concatenate(s) if s else np.zeros((0, k))

    every = fit
    for _ in range(rule.cleanings if len(fit) else 0):
        s = logits(learn(fit, 1), every)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        own = p[np.arange(len(every)), y[every]] / p.sum(axis=1)
        good = own > rule.doubt
        for c in range(k):  # of no language more than the worst part: a language that isn't learned yet isn't wrong
            mine = np.flatnonzero(y[every] == c)
            spare = np.argsort(-own[mine], kind="stable")[: int(np.ceil(len(mine) * (1 - rule.most_wrong)))]
            good[mine[spare]] = True
        fit = every[good]
    m = learn(fit, rule.rounds)
    s = logits(m, out)
    keep = s.argmax(axis=1) == y[out] if len(out) else np.zeros(0, bool)
    best, temperature = np.inf, 1.0
    if keep.sum() >= 20:
        # labels that the model contradicts are mostly wrong ones: this temperature is for the path only
        q, t = s[keep], y[out][keep]
        for c in np.geomspace(0.02, 5, 60):
            z = q / c
            z = z - z.max(axis=1, keepdims=True)
            lp = (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(t)), t]
            loss = -np.log(0.999 * np.exp(lp) + 0.001 / k).mean() + 0.002 / c
            if loss < best:
                best, temperature = loss, float(c)
    # the confidence is fitted to blocks and to whole held-out texts: logits and squared norms of a text follow from
    # those of its blocks
    if not len(out):
        return Model(names, rule, m.weights(), idf, m.bias(), temperature)
    square, (of, inv) = (norm[out] ** 2)[:, None], np.unique(text_of_block[out], return_inverse=True)
    raw, whole = np.zeros((len(of), k)), np.zeros((len(of), 1))
    np.add.at(raw, inv, (s - m.bias()) * np.sqrt(square))
    np.add.at(whole, inv, square)
    unit = float(np.median(square))
    every, labels_ = np.r_[s, raw / np.sqrt(whole) + m.bias()], np.r_[y[out], y_of[of]]
    c, growth, noise = calibrated(every, np.r_[square, whole][:, 0] / unit, labels_)
    return Model(names, rule, m.weights(), idf, m.bias(), temperature, (c, growth), noise, unit)


def _frequencies(b: Batch, ln: Lines, words: Words, flat: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """In how many of the texts of a batch each n-gram is; a text counts once, whole, without its silent lines."""
    at = _spoken(b)
    line = np.searchsorted(ln.start, b.start[at], side="right") - 1
    loud = ~ln.silent[line]
    pair = np.unique(ln.text[line[loud]] * np.int64(len(words.values) + 1) + words.number(b, at[loud]))
    text, number = pair // (len(words.values) + 1), pair % (len(words.values) + 1)
    offset, df = np.cumsum(count) - count, np.zeros(size, np.int64)
    here = np.zeros((64, size), bool)
    edge = np.searchsorted(text, np.arange(0, len(b.text_at) + 63, 64))
    for i, (x, z) in enumerate(zip(edge, edge[1:])):
        if z > x:
            reps = count[number[x:z]]
            begin = np.cumsum(reps) - reps
            f = flat[np.repeat(offset[number[x:z]] - begin, reps) + np.arange(reps.sum())]
            here[:] = False
            here[np.repeat(text[x:z] - 64 * i, reps), f] = True
            df += here.sum(axis=0)
    return df


def document_frequencies(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> tuple[int, np.ndarray]:
    """The number of documents and, of each hashed n-gram, of the documents that hold it: over all of them, whole. The
    driver sees one row per n-gram (2**bits at most)."""
    size = 1 << rule.bits

    def run(batches):
        words, flat, count, df, n = Words(200_000), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(size, np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n += len(texts)
            for a, z in portions(texts):
                b = split(texts[a:z])
                if not len(b.start):
                    continue
                if words.full():
                    words, flat, count = Words(words.most), flat[:0], count[:0]
                words.number(b, _spoken(b))
                more = grams(words.values[len(count) :], rule.longest_gram, size - 1)
                flat, count = np.r_[flat, more[0].astype(np.int32)], np.r_[count, more[1]]
                df += _frequencies(b, lines_of(b, rule.unit_chars), words, flat, count, size)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, there], pa.int32()), pa.array(np.r_[n, df[there]], pa.int64())], names=["gram", "n"])

    rows = docs.select(text).mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for r in rows:
        df[r[0]] = r[1]
    return int(df[-1]), df[:-1]


def best_path(score: np.ndarray, text: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best language of each line: scores (lines, languages), lines in order of text, cost of a change before each
    line. All texts go forward together, a line of each at a time."""
    n, k = score.shape
    state = np.zeros(n, np.int16)
    if not n:
        return state
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than j lines
    stay = np.empty((n, k), bool)
    jump = np.empty(n, np.int16)
    v = score[first].astype(np.float64)
    for j in range(1, longest):
        a = active[j]
        v_a = v[:a]
        top = v_a.argmax(axis=1)
        rows = first[:a] + j
        other = v_a[np.arange(a), top] - change[rows]
        keep = v_a >= other[:, None]
        stay[rows], jump[rows] = keep, top
        v[:a] = np.where(keep, v_a, other[:, None]) + score[rows]
    now = np.zeros(len(first), np.int16)
    for j in range(longest - 1, -1, -1):
        a = active[j]
        begun = size[:a] == j + 1
        now[:a][begun] = v[:a][begun].argmax(axis=1)
        rows = first[:a] + j
        state[rows] = now[:a]
        if j:
            s = now[:a]
            now[:a] = np.where(stay[rows, s], s, jump[rows])
    return state


class Reader:
    """Segments of texts by a model; keeps word vectors."""

    def __init__(self, model: Model):
        self.model, self.words, self.grid = model, Words(400_000), model.table()
        self.vectors = np.zeros((4096, self.grid.shape[1]), np.float32)
        self.seen = 0

    def _numbers(self, b: Batch, at: np.ndarray) -> np.ndarray:
        if self.words.full():
            self.words, self.seen = Words(self.words.most), 0
        number = self.words.number(b, at)
        r = self.model.rule
        total = len(self.words.values)
        while len(self.vectors) < total:
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for i in range(self.seen, total, 20_000):
            part = self.words.values[i : min(i + 20_000, total)]
            flat, count = grams(part, r.longest_gram, (1 << r.bits) - 1)
            self.vectors[i : i + len(part)] = np.add.reduceat(self.grid[flat], np.cumsum(count) - count, axis=0)
        self.seen = total
        return number

    def segments(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (language, first line, last line, characters, confidence) of its segments."""
        out: list[list[tuple]] = [[] for _ in texts]
        b = split(texts)
        ln = lines_of(b, self.model.rule.unit_chars)
        if not len(ln.start):
            return out
        m, r = self.model, self.model.rule
        at = _spoken(b)
        line = np.searchsorted(ln.start, b.start[at], side="right") - 1
        loud = ~ln.silent[line]
        at, line = at[loud], line[loud]
        if not len(at):
            return out
        number = self._numbers(b, at)
        mine, begin = np.unique(line, return_index=True)
        sums = np.add.reduceat(self.vectors[number], begin, axis=0)
        logp = m.scores(sums)
        size = ln.ends[mine] - ln.chars[mine]
        logp = np.maximum(logp, -(size / r.chars_per_nat)[:, None])
        text = ln.text[mine]
        seams = np.cumsum(ln.seam)[mine]
        passed = np.r_[False, seams[1:] != seams[:-1]] | ln.seam[mine]
        state = best_path(logp, text, np.where(passed, r.change_at_seam, r.change))
        # runs of one language in a text
        runs = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (state[1:] != state[:-1])])
        last = np.r_[runs[1:], len(text)] - 1
        total = np.add.reduceat(sums, runs, axis=0)
        top = np.searchsorted(ln.text, np.arange(len(texts)))
        by: dict[int, list] = {}
        for i, (a, z) in enumerate(zip(runs.tolist(), last.tolist())):
            by.setdefault(int(text[a]), []).append([int(state[a]), a, z, total[i]])
        chars = lambda s: int(ln.ends[mine[s[2]]] - ln.chars[mine[s[1]]])
        for t, every in by.items():
            segs: list[list] = []
            for s in every:  # a short one between two of one language is part of them
                if len(segs) > 1 and segs[-2][0] == s[0] and chars(segs[-1]) < r.block:
                    segs.pop()
                    segs[-1] = [s[0], segs[-1][1], s[2], segs[-1][3] + s[3]]
                else:
                    segs.append(s)
            p = m.confidences(np.stack([s[3] for s in segs]))
            for s, q in zip(segs, p):
                a, z = mine[s[1]], mine[s[2]]
                end = int(ln.ends[z])
                # without the end of the last line
                tail = b.data[ln.start[z] : ln.stop[z]]
                end -= int((tail[-2:] == 10).sum() + (tail[-2:] == 13).sum())
                out[t].append((m.names[s[0]], int(ln.line[a] - ln.line[top[t]]), int(ln.line[z] - ln.line[top[t]]), end - int(ln.chars[a]), float(q[s[0]])))
        return out


SEGMENT = "array<struct<lang:string,first_line:int,last_line:int,n_chars:bigint,confidence:double>>"


def labelled(docs: DataFrame, names: DataFrame, id_: str, lang: str) -> DataFrame:
    """(id_, known): the language a label stands for; null if it isn't one."""
    known = names.select(F.lower(F.col("label")).alias("_label"), F.col("lang").alias("known")).dropDuplicates(["_label"])
    return docs.select(F.col(id_), entity_key(lang).alias("_label")).join(known, "_label", "left").select(id_, "known")


def fitted(docs: DataFrame, names: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", rule: Rule = Rule()) -> Model:
    """A model from at most rule.sample_per_language documents of each language: those with the lowest hash of their
    id, of at most rule.sample_chars characters. Only this bounded sample comes to the driver, and the document
    frequencies of the corpus."""
    languages = [r[0] for r in names.select("lang").distinct().orderBy("lang").collect()]  # a fixed table
    fits = F.length(text).between(rule.block, rule.sample_chars)
    ids = labelled(docs.where(fits), names, id_, lang).where(F.col("known").isNotNull()).groupBy(id_).agg(F.min("known").alias("known"))
    w = W.partitionBy("known").orderBy(F.xxhash64(F.col(id_), F.lit("sample")), id_)
    ids = ids.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rule.sample_per_language).select(id_, "known")
    rows = docs.select(id_, text).where(fits).join(F.broadcast(ids), id_)
    rows = rows.groupBy(id_, "known").agg(F.min(text).alias(text)).select(id_, text, "known").orderBy(id_).collect()  # one row per id
    if not rows:
        raise ValueError("no labelled document to learn from")
    place = {n: i for i, n in enumerate(languages)}
    return train([r[1] for r in rows], [place[r[2]] for r in rows], languages, rule, document_frequencies(docs, text, rule))


def read(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, n_chars, segments) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**bits rows at most

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, z in portions(texts):
                segs = reader.segments(texts[a:z])
                arr = pa.array(
                    [[{"lang": s[0], "first_line": s[1], "last_line": s[2], "n_chars": s[3], "confidence": s[4]} for s in d] for d in segs],
                    pa.list_(pa.struct([("lang", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("n_chars", pa.int64()), ("confidence", pa.float64())])),
                )
                n = pa.array([len(t) for t in texts[a:z]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, z - a) for i in range(len(keep))), n, arr], names=[*keep, "n_chars", "segments"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", n_chars bigint, segments {SEGMENT}")


def segments(docs: DataFrame, names: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", rule: Rule = Rule()) -> DataFrame:
    """(id_, segment, lang, first_line, last_line, n_chars, confidence)."""
    r = read(docs, fitted(docs, names, id_, text, lang, rule), [id_], text)
    return r.select(id_, F.posexplode("segments").alias("segment", "s")).select(id_, "segment", "s.*")


def mislabelled(docs: DataFrame, names: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", rule: Rule = Rule()) -> DataFrame:
    """(id_, lang, confidence): for documents of at least rule.block characters whose label isn't the one of their only
    language, every language of a block."""
    r = read(docs, fitted(docs, names, id_, text, lang, rule), [id_, lang], text).where(F.col("n_chars") >= rule.block)
    blocks = F.filter("segments", lambda s: s["n_chars"] >= rule.block)
    r = r.withColumn("_langs", F.array_distinct(F.transform(blocks, lambda s: s["lang"]))).withColumn("_b", blocks)
    known = names.select(F.lower(F.col("label")).alias("_label"), F.col("lang").alias("_known")).dropDuplicates(["_label"])
    r = r.withColumn("_label", entity_key(lang)).join(known, "_label", "left")
    right = (F.size("_langs") == 1) & F.coalesce(F.col("_langs")[0] == F.col("_known"), F.lit(False))
    r = r.where(~right).select(F.col(id_), F.explode("_langs").alias("_lang"), "_b")
    sure = F.array_max(F.transform(F.filter("_b", lambda s: s["lang"] == F.col("_lang")), lambda s: s["confidence"]))
    return r.select(id_, F.col("_lang").alias("lang"), sure.alias("confidence"))
