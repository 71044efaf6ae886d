"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (runs of letters and digits, lower-cased) are read in windows of `WINDOW` words that overlap by half.
Each word has two inputs: an embedding of the word (hashed), and a convolution over its characters in their order, three
wide, with the largest value of each filter over the word. A forward and a backward gated recurrent layer run over a
window, attention weighs their states, and a logistic unit scores the pool. A document's score is the calibrated score of
its highest window; every window of every text is scored.

Two numbers of each word and one of each character 4-gram are not trained but counted: how much likelier it is in toxic
documents, and in how many it occurs. While the network learns, a document's own fold is left out of these counts, so
that a word of one document says nothing of it; else the network would trust words that happen to be rare.

Training reads a bounded sample of labelled documents: `per_class` of each class at most, and SAMPLE_BYTES of each, in the
order of a hash of the id; texts of over SAMPLE_TEXT bytes never train. Windows of clean documents are clean, and of a
toxic document the highest window by the last round's network is toxic. A quarter of the sample is kept from training:
rounds go on until its loss stops falling, and it sets the calibration.

Null and empty texts get the score of an empty window. A text of any length is scored whole, by one task. Null ids are
kept (and never train: labels are joined by id); several labels of one id count as toxic if any is; rows and ties alike
get equal scores. Without labels of both classes the score is the share of toxic labels (0.5 without any). An empty table
gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, blocks, fields_of, held_out, mix64, table, text_bytes, whole_rows

WINDOW, STRIDE = 24, 12
HIDDEN, EMBED = 12, 8
BYTE, FILTERS = 6, 8  # dimensions of a character's embedding, and filters over three characters
LEAST_ROUNDS = 3
COUNTED = 2  # columns of a word's embedding that are counted
WORD_ROWS, COUNT_ROWS, GRAM_ROWS = 1 << 13, 1 << 19, 1 << 16
FOLDS = 4
PER_CLASS = 2500
SAMPLE_BYTES, SAMPLE_TEXT = 4 << 20, 64 << 10
BLOCK = 2 << 20
THRESHOLD = 0.3

_PLAIN = np.full(256, 32, np.uint8)
for _a, _z in ((48, 58), (97, 123), (128, 256)):
    _PLAIN[_a:_z] = np.arange(_a, _z)
_PLAIN[65:91] = np.arange(97, 123)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


# --- inputs -------------------------------------------------------------------------------------------------------


@dataclass
class Inputs:
    """ids: word number of each word of the block; first: index of each text's first word; rows: row of each distinct
    word among the counted ones (its low bits are that among the trained ones); chars: characters of the distinct words, each between marks; grams: row of the 4-gram that begins at
    each character; char_at: where each distinct word's characters begin."""

    ids: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    chars: np.ndarray
    grams: np.ndarray
    char_at: np.ndarray

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window, text of each window)."""
        n = np.diff(self.first)
        k = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), k)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
        return self.first[:-1][text] + nth * STRIDE, text

    def window_ids(self, start: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Word numbers (windows, WINDOW); beyond the text's end the number of distinct words."""
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.first[text + 1][:, None]
        if not len(self.ids):
            return np.full(at.shape, len(self.rows))
        return np.where(inside, self.ids[np.minimum(at, len(self.ids) - 1)], len(self.rows))


def inputs(data: np.ndarray, offsets: np.ndarray) -> Inputs:
    plain = _PLAIN[data]
    if len(data) > 1:  # capitals of two bytes in Latin-1 letters
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        plain[1:][big] += 32
    words = Words(plain, offsets, lower=False)
    found = words.array().dictionary_encode()
    ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(found) else np.zeros(0, np.int64)
    distinct = found.dictionary
    n = len(distinct)
    o = np.frombuffer(distinct.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
    text = np.frombuffer(distinct.buffers()[2], np.uint8)[o[0] : o[-1]] if n else np.zeros(0, np.uint8)
    o = o - o[0]
    size = np.diff(o)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE))
    place = np.arange(len(text)) - np.repeat(o[:-1], size)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[place], out=total[1:])
    rows = (mix64(total[o[1:]] - total[o[:-1]]) % np.uint64(COUNT_ROWS)).astype(np.int64)
    # ^word$ end to end
    marked = np.full(len(text) + 2 * n, 36, np.uint8)
    word = np.repeat(np.arange(n), size)
    marked[np.arange(len(text)) + 2 * word + 1] = text
    begin = o + 2 * np.arange(n + 1)
    marked[begin[:-1]] = 94
    of = np.repeat(np.arange(n), size + 2)
    left = begin[1:][of] - np.arange(len(marked))  # characters to the word's end
    four = np.zeros(len(marked), np.uint64)
    for k in range(4):
        after = np.append(marked, np.zeros(4, np.uint8))[k : k + len(marked)]
        four |= np.where(left > k, after, 0).astype(np.uint64) << np.uint64(8 * k)
    grams = (mix64(four) % np.uint64(GRAM_ROWS)).astype(np.int32)
    return Inputs(ids, words.first, rows, marked, grams, begin)


def _only(x: Inputs, words: np.ndarray) -> Inputs:
    """The inputs of some distinct words."""
    k = np.diff(x.char_at)[words]
    flat = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - x.char_at[words], k)
    return Inputs(np.zeros(0, np.int64), np.zeros(1, np.int64), x.rows[words], x.chars[flat], x.grams[flat], np.append(0, np.cumsum(k)))


# --- the network --------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Counts:
    """What is counted in labelled documents: (COUNT_ROWS, COUNTED) of words, (GRAM_ROWS,) of 4-grams."""

    word: np.ndarray
    gram: np.ndarray


class Network:
    """Parameters by name in `p` (float32)."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        put = lambda *s, scale=0.3: (g.standard_normal(s) * scale).astype(np.float32)
        self.p = {"word": put(WORD_ROWS, EMBED - COUNTED, scale=0.05), "byte": put(256, BYTE, scale=0.2), "K": put(3 * (BYTE + 1), FILTERS), "k": put(FILTERS, scale=0)}
        for d in ("f", "b"):
            self.p |= {f"W{d}": put(EMBED + FILTERS, 3 * HIDDEN, scale=0.15), f"U{d}": put(HIDDEN, 3 * HIDDEN, scale=0.15), f"c{d}": put(3 * HIDDEN, scale=0)}
        self.p |= {"A": put(2 * HIDDEN, HIDDEN, scale=0.15), "v": put(HIDDEN, scale=0.15), "w": put(2 * HIDDEN, scale=0.15), "o": np.array([-1.0], np.float32)}
        # the first unit of each direction starts as a reader of the counted columns, which attention looks for: the
        # network sets out from the window's most telling word, and training departs from there
        for d, unit in (("f", 0), ("b", HIDDEN)):
            self.p[f"W{d}"][:, [0, 2 * HIDDEN]] = 0
            self.p[f"W{d}"][:COUNTED, 2 * HIDDEN] = (1.5, 0.5)
            self.p[f"U{d}"][:, [0, 2 * HIDDEN]] = 0
            self.p[f"c{d}"][[0, 2 * HIDDEN]] = (-3.0, -2.0)
            self.p["A"][unit, 0], self.p["w"][unit] = 1.5, 1.5
        self.p["v"][0] = 3.0
        self.counts = Counts(np.zeros((COUNT_ROWS, COUNTED), np.float32), np.zeros(GRAM_ROWS, np.float32))
        self.scale, self.shift = 1.0, 0.0

    def characters(self, x: Inputs, counts: Counts) -> np.ndarray:
        """What the filters see at each character: it and its neighbours in the word."""
        one = np.concatenate([self.p["byte"][x.chars], counts.gram[x.grams][:, None]], axis=1)
        before, after = np.roll(one, 1, axis=0), np.roll(one, -1, axis=0)
        before[x.char_at[:-1]] = 0
        after[x.char_at[1:] - 1] = 0
        return np.concatenate([before, one, after], axis=1)

    def embed(self, x: Inputs, counts: Counts | None = None) -> np.ndarray:
        """Inputs of each distinct word, and of the padding."""
        counts = counts or self.counts
        out = np.zeros((len(x.rows) + 1, EMBED + FILTERS), self.p["word"].dtype)
        out[:-1, :COUNTED], out[:-1, COUNTED:EMBED] = counts.word[x.rows], self.p["word"][x.rows % WORD_ROWS]
        step = 1 << 13
        for lo in range(0, len(x.rows), step):
            part = x if len(x.rows) <= step else _only(x, np.arange(lo, min(lo + step, len(x.rows))))
            high = np.tanh(self.characters(part, counts) @ self.p["K"] + self.p["k"])
            out[lo : lo + len(part.rows), EMBED:] = np.maximum.reduceat(high, part.char_at[:-1], axis=0)
        return out

    def forward(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: bool = False):
        """Logits of windows (n, WINDOW) of word numbers; gates: the words' products with the input weights."""
        n, pad = len(ids), len(gates["f"]) - 1
        states = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        tape: dict[str, list] = {"f": [], "b": []}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            h, u, side = np.zeros((n, HIDDEN), np.float32), self.p[f"U{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                x = gates[d][ids[:, t]]
                r = h @ u
                zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])))
                z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
                if keep:
                    tape[d].append((t, h, z, reset, new, r[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[t, :, side] = h
        a = np.tanh(states @ self.p["A"])
        e = (a @ self.p["v"]).T
        blank = ids == pad
        e = np.where(blank, np.float32(-1e9), e)
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        pool = np.einsum("nt,tnh->nh", weight, states)
        logit = pool @ self.p["w"] + self.p["o"][0]
        return (logit, states, a, weight, pool, blank, tape) if keep else logit

    def gates(self, words: np.ndarray) -> dict[str, np.ndarray]:
        return {d: words @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in ("f", "b")}

    def backward(self, x: Inputs, words: np.ndarray, ids: np.ndarray, y: np.ndarray, share: np.ndarray, counts: Counts | None = None) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss of windows; words: embed(x, counts)."""
        counts = counts or self.counts
        p = self.p
        logit, states, a, weight, pool, blank, tape = self.forward(self.gates(words), ids, keep=True)
        d_logit = ((_sigmoid(logit) - y) * share).astype(np.float32)
        g = {"w": pool.T @ d_logit, "o": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["w"]
        d_weight = np.einsum("nh,tnh->nt", d_pool, states)
        d_states = weight.T[:, :, None] * d_pool
        d_e = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_e[blank] = 0
        g["v"] = np.einsum("tnk,nt->k", a, d_e)
        d_a = d_e.T[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = np.einsum("tnh,tnk->hk", states, d_a)
        d_states = d_states + d_a @ p["A"].T
        d_words = np.zeros_like(words)
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, gu = p[f"U{d}"], np.zeros_like(p[f"U{d}"])
            d_gate_all = np.zeros((len(words), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(ids), HIDDEN), np.float32)
            for t, h, z, reset, new, rn in reversed(tape[d]):
                dh = dh + d_states[t, :, side]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * rn * reset * (1 - reset)
                d_rec = np.concatenate([d_z, d_r, d_new * reset], axis=1)
                np.add.at(d_gate_all, ids[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                gu += h.T @ d_rec
                dh = dh * z + d_rec @ u.T
            g[f"U{d}"] = gu
            g[f"c{d}"] = d_gate_all.sum(0)
            g[f"W{d}"] = words.T @ d_gate_all
            d_words += d_gate_all @ p[f"W{d}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], x.rows % WORD_ROWS, d_words[:-1, COUNTED:EMBED])
        seen = self.characters(x, counts)
        high = np.tanh(seen @ p["K"] + p["k"])
        of = np.repeat(np.arange(len(x.rows)), np.diff(x.char_at))
        d_high = np.where(high == words[of, EMBED:], d_words[of, EMBED:], 0) * (1 - high * high)
        g["K"], g["k"] = seen.T @ d_high, d_high.sum(0)
        d_seen = (d_high @ p["K"].T).reshape(len(of), 3, BYTE + 1)[:, :, :BYTE]
        d_one = d_seen[:, 1].copy()
        back, ahead = np.ones(len(of), bool), np.ones(len(of), bool)
        back[x.char_at[:-1]] = ahead[x.char_at[1:] - 1] = False  # characters with one before, and one after
        d_one[np.flatnonzero(back) - 1] += d_seen[back, 0]
        d_one[np.flatnonzero(ahead) + 1] += d_seen[ahead, 2]
        g["byte"] = np.zeros_like(p["byte"])
        np.add.at(g["byte"], x.chars, d_one)
        return g

    def window_logits(self, x: Inputs, counts: Counts | None = None, texts: np.ndarray | None = None, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(logits, texts) of all windows, or of those of texts for which `texts` is true."""
        start, text = x.windows()
        number = np.arange(len(x.rows) + 1)
        if texts is not None:  # only the words of these
            start, text = start[texts[text]], text[texts[text]]
            met = np.unique(x.ids[np.repeat(texts, np.diff(x.first))])
            number = np.full(len(x.rows) + 1, len(met))
            number[met] = np.arange(len(met))
        gates = self.gates(self.embed(x if texts is None else _only(x, met), counts))
        out = [self.forward(gates, number[x.window_ids(start[lo : lo + step], text[lo : lo + step])]) for lo in range(0, len(start), step)]
        return (np.concatenate(out) if out else np.zeros(0, np.float32)), text

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text the calibrated score of its highest window."""
        if len(offsets) == 1:
            return np.zeros(0)
        logit, text = self.window_logits(inputs(data, offsets))
        top = np.maximum.reduceat(logit, np.flatnonzero(np.append(True, text[1:] != text[:-1])))
        return np.round(_sigmoid(self.scale * top.astype(np.float64) + self.shift), 6)


def count_in(x: Inputs, toxic: np.ndarray, folds: int, step: int = 64) -> list[Counts]:
    """Counts over all documents of x but those of each fold (document mod folds), and last over all."""
    size = {"word": COUNT_ROWS, "gram": GRAM_ROWS}
    n, hit = ({k: np.zeros((folds, z), np.float32) for k, z in size.items()} for _ in range(2))

    def add(kind: str, doc: np.ndarray, row: np.ndarray):
        pair = np.unique(doc.astype(np.int64) * size[kind] + row)
        doc, row = pair // size[kind], pair % size[kind]
        np.add.at(n[kind], (doc % folds, row), 1)
        np.add.at(hit[kind], (doc % folds, row), toxic[doc])

    for a in range(0, len(toxic), step):  # a few documents are counted at a time
        z = min(a + step, len(toxic))
        doc, word = np.repeat(np.arange(a, z), np.diff(x.first[a : z + 1])), x.ids[x.first[a] : x.first[z]]
        pair = np.unique(doc * max(1, len(x.rows)) + word)
        doc, word = pair // max(1, len(x.rows)), pair % max(1, len(x.rows))
        add("word", doc, x.rows[word])
        k = np.diff(x.char_at)[word]
        add("gram", np.repeat(doc, k), x.grams[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k - x.char_at[word], k)])
    base = max(toxic.mean(), 1e-3)
    few = 3.0  # meetings that a row without any counts as

    def odds(n: np.ndarray, hit: np.ndarray) -> np.ndarray:
        return (0.5 * (np.log((hit + few * base) / (n - hit + few * (1 - base))) - np.log(base / (1 - base)))).clip(-3, 3).astype(np.float32)

    out = []
    for f in [*range(folds), None]:
        of = {k: ((n[k].sum(0), hit[k].sum(0)) if f is None else (n[k].sum(0) - n[k][f], hit[k].sum(0) - hit[k][f])) for k in size}
        share = folds / (folds - 1) if f is not None and folds > 1 else 1.0  # so that numbers of documents are alike
        out.append(Counts(np.column_stack([odds(*of["word"]), 0.5 * np.log1p(share * of["word"][1])]).astype(np.float32), odds(*of["gram"])))
    return out


def fit(texts: list[bytes], toxic: np.ndarray, prior: float = 0.5, rounds: int = 8, batch: int = 256, rate: float = 0.01, seed: int = 7) -> Network:
    """A network for texts with labels. Every fourth document of each class is kept from training: its loss ends the
    rounds, and it calibrates the score for a share `prior` of toxic documents."""
    net, g = Network(seed), np.random.default_rng(seed)
    nth = np.zeros(len(toxic), np.int64)
    for c in (0, 1):
        nth[toxic == c] = np.arange((toxic == c).sum())
    held = nth % 4 == 3
    put = lambda rows: inputs(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    x, y = put([t for t, h in zip(texts, held, strict=True) if not h]), toxic[~held].astype(np.float64)
    rest, ry = put([t for t, h in zip(texts, held, strict=True) if h]), toxic[held].astype(np.float64)
    folds = min(FOLDS, max(1, int(min(y.sum(), len(y) - y.sum()))))
    tables = count_in(x, y, folds)
    net.counts = tables[-1]
    fold = np.arange(len(y)) % folds
    start, text = x.windows()
    # before the first round a window ranks by its word of highest log-odds
    rank = np.zeros(len(start), np.float32)
    for f in range(folds):
        heat = np.append(tables[f].word[:, 0][x.rows], np.float32(-9))
        mine = np.flatnonzero(fold[text] == f)
        for lo in range(0, len(mine), 4096):
            j = mine[lo : lo + 4096]
            rank[j] = heat[x.window_ids(start[j], text[j])].max(1)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    step, best, kept, worse = 0, np.inf, None, 0
    for r in range(rounds + 1):
        if r >= LEAST_ROUNDS and 0 < ry.sum() < len(ry):  # a small sample's loss says little before
            logit, of = net.window_logits(rest)
            high = np.full(len(ry), -np.inf)
            np.maximum.at(high, of, logit)
            net.scale, net.shift = _calibrate(high, ry)
            z, w = net.scale * high + net.shift, np.where(ry == 1, 0.5 / ry.sum(), 0.5 / (len(ry) - ry.sum()))
            loss = float((w * (np.logaddexp(0, z) - ry * z)).sum())
            if loss < best - 1e-4:
                best, kept, worse = loss, ({k: a.copy() for k, a in net.p.items()}, net.scale, net.shift), 0
            elif (worse := worse + 1) == 3:
                break
        if r == rounds:
            break
        order = np.lexsort((-rank, text))
        top = order[np.append(True, text[order][1:] != text[order][:-1])]
        hot, hard = top[y[text[top]] == 1], top[y[text[top]] == 0]
        clean = np.flatnonzero(y[text] == 0)
        # of the clean windows the highest of each document and as many again at random
        clean = np.union1d(hard, g.choice(clean, min(len(clean), 2 * max(len(hot), 200)), replace=False)) if len(clean) else clean
        pick = np.concatenate([hot, clean])
        label = np.concatenate([np.ones(len(hot)), np.zeros(len(clean))])
        share = np.where(label == 1, len(pick) / (2 * max(1, len(hot))), len(pick) / (2 * max(1, len(clean))))
        todo = []
        for f in range(folds):
            mine = np.flatnonzero(fold[text[pick]] == f)
            if len(mine):
                long = np.concatenate([g.permutation(mine) for _ in range(-(-4 * batch // len(mine)))])  # 4 steps of a fold at least
                todo += [(f, long[lo : lo + batch]) for lo in range(0, len(long), batch)]
        for i in g.permutation(len(todo)):
            f, j = todo[i]
            ids = x.window_ids(start[pick[j]], text[pick[j]])
            met, inv = np.unique(ids, return_inverse=True)
            part = _only(x, met[met < len(x.rows)])
            grad = net.backward(part, net.embed(part, tables[f]), inv.reshape(ids.shape), label[j], share[j] / len(j), tables[f])
            step += 1
            for name, d in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * d
                v[name] = 0.99 * v[name] + 0.01 * d * d
                net.p[name] = (net.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                if name == "word":
                    net.p[name] *= np.float32(0.998)
        for f in range(folds):
            rank[fold[text] == f] = net.window_logits(x, tables[f], fold == f)[0]
    if kept:
        net.p, net.scale, net.shift = kept
    net.counts = count_in(put(texts), toxic.astype(np.float64), 1)[-1]
    net.shift += float(np.log(prior / (1 - prior)))
    return net


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift by logistic regression, both classes of equal weight."""
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    mid, spread = np.average(logit, weights=w), max(float(np.sqrt(np.cov(logit, aweights=w))), 1e-6)
    u, a, b = (logit - mid) / spread, 1.0, 0.0
    for _ in range(300):
        d = (_sigmoid(a * u + b) - y) * w
        a, b = a - 4 * ((d * u).sum() + 0.004 * a), b - 4 * d.sum()
    a = max(a, 0.05)
    return a / spread, b - a * mid / spread


# --- Spark --------------------------------------------------------------------------------------------------------


class Constant:
    """Stands in where labels of both classes are missing."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.score)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """A scorer learned from `docs` (doc_id, text) by `labels` (doc_id, toxic)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marks = marks.join(docs.select("doc_id").hint("merge"), "doc_id", "left_semi")
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Constant(float(max(counts)) if counts else 0.5)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text")).where(F.col("size") <= SAMPLE_TEXT)
    found = []
    for c in sorted(counts):
        ids = marks.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        some = texts.join(F.broadcast(ids), "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "text").limit(per_class)  # per_class ids at most
        upto = Window.orderBy("h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        some = some.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= SAMPLE_BYTES)
        found += [(c, r["text"].encode()) for r in some.orderBy("upto", "h").select("text").collect()]  # SAMPLE_BYTES at most
    if len({c for c, _ in found}) < 2:
        return Constant(counts[1] / sum(counts.values()))
    prior = min(max(counts[1] / sum(counts.values()), 0.02), 0.5)
    return fit([t for _, t in found], np.array([c for c, _ in found]), prior)


def score_toxicity(docs: DataFrame, scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score and predicted for each row of `docs`."""
    known = docs.sparkSession.sparkContext.broadcast(scorer)  # of fixed size: the network's parameters
    schema = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep) + ", score double, predicted int"

    def rows(batches):
        for block in blocks(batches, limit=BLOCK):
            score = known.value.scores(*text_bytes(block))
            yield pa.RecordBatch.from_arrays([*(block.column(k).combine_chunks() for k in keep), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, "text").mapInArrow(rows, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4))
    return score_toxicity(docs, train(docs, labels), keep=("doc_id", "held_out"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that are predicted toxic; all columns stay, whatever
    their names."""
    scorer = train(docs, labels.where(~held_out("doc_id", 4)))
    known = docs.sparkSession.sparkContext.broadcast(scorer)
    rows_ = docs.select(whole_rows(docs).alias("row"), F.col("text"))

    def rows(batches):
        for block in blocks(batches, limit=BLOCK):
            yield from block.filter(pa.array(known.value.scores(*text_bytes(block)) < THRESHOLD)).select(["row"]).combine_chunks().to_batches()

    kept = rows_.mapInArrow(rows, StructType([rows_.schema["row"]]))
    return kept.select(*fields_of(docs.columns))
