"""Problem 10: keyword-stuffed pages, link lists and tag lists.

Each page is cut into units: lines, and sentences of lines, of at most UNIT
tokens.  Every unit has content features (repetition within itself, how often
the page repeats its pairs of words and its opening, numbers, separators) and
link features (links, anchors, tags); a long page is looked at in blocks.
Bagged decision trees are trained on units of a bounded sample of pages whose
blocks weak rules label as a whole by their counts; blocks that fit no rule, or
rules that disagree, teach nothing.
The trees judge every unit of every page, and the prediction for a page is the
part of its visible characters that lies in units judged to be stuffed.  It is
smoothed with the rate of such characters on the page's host, which is counted
over all pages.  A page is spam if its smoothed score is above one half.

Defined cases: null and empty texts, and texts without a token, are no spam
(page score 0); a null host has no rate and smooths nothing; equal texts get
equal page scores; where the sample has no page of either label, no page is
spam.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import bounded_sample, cut, small

#: Pages that the trees are fitted on at most (the first by a hash of their id), and units of ordinary and of spam pages among them.
SAMPLE, FIT_UNITS = 15_000, (24_000, 6_000)
TREES, DEPTH, LEAF, BAG = 15, 10, 3, 15_000
#: Tokens of a unit at most, and the fewest of a block where a page has several.
UNIT, BLOCK = 48, 512
#: Pseudo-pages that the overall rate counts as in the rate of a host, and the weight of that rate in the score.
PRIOR, HOST = 20.0, 0.1
#: Characters that a task looks at in one go; a longer text is looked at by itself.
CHUNK = 1 << 21

WORD, NUMBER, LINK, TAG, LINE, END, MARK, BAR = range(8)
TOKEN = re.compile(
    r"<a\s[^<>]*>[^<]*</a>|\[[^\]\[\n]*\]\([^()\n]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|[^\W_][\w\-]*(?:\.[\w\-]+)+/[^\s<>\"')\]]*"
    r"|#[^\W_]\w*|\n|[^\W_][\w'’ऀ-ൿ‌‍\-]*|[.!?।]+(?=\s|$)|[|/•·»,;]|[\-–—](?=\s)",
    re.I,
)
FEATURES = (
    "words", "link_chars", "links", "tag_chars", "numbers", "again", "pairs_again", "page_pairs", "page_words", "openings", "marks", "bars", "ended",
    "word_length", "short_words", "page_links", "page_tags", "page_distinct", "page_tokens",
)


def kind_of(t: str) -> int:
    c = t[0]
    if c == "\n":
        return LINE
    if c in "<[" or "://" in t or t[:4].lower() == "www." or "." in t and "/" in t:
        return LINK
    if c == "#":
        return TAG
    if c in ".!?।":
        return END
    if not c.isalnum():
        return MARK if c in ",;-–—" else BAR
    return NUMBER if any(x.isdigit() for x in t) else WORD


class Units:
    """Tokens of some texts in arrays, cut into units, with their features.
    `page` is the block of a token: a page, or an even part of a long one."""

    def __init__(self, texts: list[str]) -> None:
        flat: list[str] = []
        many = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            toks = TOKEN.findall(t) if t else []
            many[i] = len(toks)
            flat += toks
        at: dict[str, int] = defaultdict(count().__next__)
        token = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
        kind = np.array([kind_of(t) for t in at], np.int8)
        self.kind = kind[token] if len(at) else np.zeros(0, np.int8)
        size = np.array([len(t) for t in at], np.int64)
        size[kind > TAG] = 0
        self.size = size[token] if len(at) else token
        hashes = np.array([xxhash.xxh3_64_intdigest(t.lower().encode("utf-8", "surrogatepass")) >> 1 for t in at], np.int64)
        self.hash = hashes[token] if len(at) else token
        text = np.repeat(np.arange(len(texts)), many)
        n = len(token)
        # Long pages are looked at in blocks of even size, so that repetition means the same in all of them.
        blocks = np.maximum(1, many // BLOCK)
        within = np.arange(n) - np.repeat(np.cumsum(many) - many, many)
        self.page = np.repeat(np.cumsum(blocks) - blocks, many) + within * np.repeat(blocks, many) // np.maximum(1, np.repeat(many, many))
        self.n_pages = int(blocks.sum())
        if not n:
            self.unit, self.n_units, self.page_of, self.text_of = token, 0, token, token
            return
        fresh = np.ones(n, bool)
        fresh[1:] = (self.page[1:] != self.page[:-1]) | np.isin(self.kind[:-1], (LINE, END))
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        fresh |= (np.arange(n) - start) % UNIT == 0
        self.unit = np.cumsum(fresh) - 1
        self.n_units = int(self.unit[-1]) + 1
        self.page_of, self.text_of = self.page[fresh], text[fresh]

    def per(self, by: np.ndarray, n: int, what: np.ndarray) -> np.ndarray:
        return np.bincount(by, weights=what, minlength=n)

    def repeated(self, group: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How often each key occurs in its group."""
        mixed = (key * np.int64(0x9E3779B97F4A7C1) ^ group * np.int64(0x2545F4914F6CDD1D)) & np.int64((1 << 62) - 1)
        _, inv, c = np.unique(mixed, return_inverse=True, return_counts=True)
        return c[inv]

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(features of each unit, visible characters of each unit)."""
        u, n, k, p, m = self.unit, self.n_units, self.kind, self.page, self.n_pages
        if not n:
            return np.zeros((0, len(FEATURES))), np.zeros(0)
        word, size = k == WORD, self.size.astype(float)
        visible = self.per(u, n, size)
        total = np.maximum(visible, 1.0)
        words = self.per(u, n, word)
        some = np.maximum(words, 1.0)
        tokens = np.maximum(self.per(u, n, (k <= TAG)), 1.0)
        w = np.flatnonzero(word & (self.size > 3))
        again, often = np.zeros(len(k)), np.zeros(len(k))
        again[w] = self.repeated(u[w], self.hash[w]) > 1
        often[w] = self.repeated(p[w], self.hash[w]) > 2
        long_ = np.maximum(self.per(u, n, word & (self.size > 3)), 1.0)
        j = np.flatnonzero(word[:-1] & word[1:] & (u[:-1] == u[1:]))
        two = self.hash[j] * np.int64(31) + self.hash[j + 1]
        own, page = np.zeros(len(k), bool), np.zeros(len(k), bool)
        for mark, hit in ((own, self.repeated(u[j], two) > 1), (page, self.repeated(p[j], two) > 2)):
            mark[j[hit]] = True
            mark[j[hit] + 1] = True
        first = np.flatnonzero(np.diff(u, prepend=-1))
        second = np.minimum(first + 1, len(k) - 1)
        opening = self.hash[first] + np.where(u[second] == u[first], self.hash[second], 0)
        units = np.maximum(self.per(self.page_of, m, np.ones(n)), 1.0)
        heads = self.repeated(self.page_of, opening)
        ended = np.zeros(n)
        ended[u[k == END]] = 1.0
        ptok = np.maximum(self.per(p, m, (k <= TAG)), 1.0)
        distinct = self.per(p[w], m, 1.0 / self.repeated(p[w], self.hash[w])) if len(w) else np.zeros(m)
        plong = np.maximum(self.per(p[w], m, np.ones(len(w))), 1.0)
        of = self.page_of
        cols = [
            np.log1p(words), self.per(u, n, size * (k == LINK)) / total, self.per(u, n, k == LINK) / tokens, self.per(u, n, size * (k == TAG)) / total,
            self.per(u, n, k == NUMBER) / tokens, self.per(u, n, again) / long_, self.per(u, n, own) / some, self.per(u, n, page & word) / some,
            self.per(u, n, often) / long_, np.where(heads > 2, heads / units[of], 0.0), self.per(u, n, k == MARK) / tokens, self.per(u, n, k == BAR) / tokens, ended,
            self.per(u, n, size * word) / some, self.per(u, n, word & (self.size <= 3)) / some, (self.per(p, m, k == LINK) / ptok)[of],
            (self.per(p, m, k == TAG) / ptok)[of], (distinct / plong)[of], np.log1p(ptok)[of],
        ]
        return np.stack(cols, 1), visible

    def votes(self) -> np.ndarray:
        """Weak label of each block by its counts as a whole: 1 spam, 0 not, -1 unknown.

        For spam: many tokens are links or tags; or words recur and there are no
        numbers; or separators stand after every few words, with few numbers.
        Against, where there is no link or tag and separators are rare: numbers
        stand among them, in half of the units if a word is frequent, or few words
        recur.  Rules that disagree give
        no label.
        """
        p, m, k = self.page, self.n_pages, self.kind
        c = {x: self.per(p, m, k == x) for x in range(8)}
        words, numbers, marks = c[WORD], c[NUMBER], c[MARK] + c[BAR]
        w = np.flatnonzero((k == WORD) & (self.size > 3))
        distinct, long_, top = np.zeros(m), np.zeros(m), np.zeros(m)
        if len(w):
            c_ = self.repeated(p[w], self.hash[w])
            distinct, long_ = self.per(p[w], m, 1.0 / c_), self.per(p[w], m, np.ones(len(w)))
            np.maximum.at(top, p[w], c_)
        text, links = words + numbers, c[LINK] + c[TAG]
        few = numbers <= 0.15 * text
        yes = (links >= 4) & (links >= 0.3 * (text + links))
        yes |= (links == 0) & (numbers <= 0.01 * words) & (top >= 4) & (distinct <= 0.5 * long_) & (c[END] <= 0.2 * words)
        yes |= (c[BAR] >= 6) & (c[BAR] >= 0.15 * text) & few | (marks >= 8) & (marks >= 0.3 * text) & few
        told = np.zeros(self.n_units)
        told[self.unit[k == NUMBER]] = 1.0
        told = self.per(self.page_of, m, told) >= 0.5 * self.per(self.page_of, m, np.ones(self.n_units))
        plain = (links == 0) & (text >= 4)
        no = plain & told & (numbers >= 0.15 * text)
        plain &= marks <= 0.15 * text
        no |= plain & (numbers >= 0.03 * text) & (told | (top <= 0.12 * long_) | (top <= 3)) | plain & ((distinct >= 0.8 * long_) | (top <= 2))
        no |= (links == 0) & (marks <= 3) & (text < 8)
        return np.where(yes & ~no, 1, np.where(no & ~yes, 0, -1))


class Trees:
    """Bagged decision trees (Gini), fitted with numpy."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 7) -> None:
        self.n, self.depth, self.leaf, self.rng = trees, depth, leaf, np.random.default_rng(seed)
        self.trees: list = []

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):  # noqa: ANN202
        p = float(y.mean())
        if depth == 0 or len(y) < 2 * self.leaf or p in (0.0, 1.0):
            return p
        best = (0.0, None, None)
        base = p * (1 - p) * len(y)
        for f in self.rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
            v = x[:, f]
            order = np.argsort(v, kind="stable")
            s, c = v[order], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (s[1:] > s[:-1]) & (k >= self.leaf) & (len(y) - k >= self.leaf)
            if not ok.any():
                continue
            left, right = c[:-1] / k, (c[-1] - c[:-1]) / (len(y) - k)
            gain = np.where(ok, base - left * (1 - left) * k - right * (1 - right) * (len(y) - k), -1.0)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((s[i] + s[i + 1]) / 2))
        if best[1] is None:
            return p
        go = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[go], y[go], depth - 1), self._grow(x[~go], y[~go], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.trees = []
        for _ in range(self.n):
            i = self.rng.integers(0, len(y), min(len(y), BAG))
            self.trees.append(self._grow(x[i], y[i], self.depth))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t, idx: np.ndarray, out: np.ndarray) -> None:  # noqa: ANN001
            if not len(idx):
                return
            if isinstance(t, float):
                out[idx] += t
                return
            go = x[idx, t[0]] <= t[1]
            walk(t[2], idx[go], out)
            walk(t[3], idx[~go], out)

        out = np.zeros(len(x))
        for t in self.trees:
            walk(t, np.arange(len(x)), out)
        return out / max(1, len(self.trees))


def parts(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK characters."""
    own, n = [], 0
    for t in texts:
        own.append(t or "")
        n += len(own[-1])
        if n >= CHUNK:
            yield own
            own, n = [], 0
    if own:
        yield own


def page_scores(texts: list[str | None], model: Trees) -> np.ndarray:
    """The part of each text's visible characters in units that the trees judge to be stuffed."""
    out = []
    for run in parts(texts):
        u = Units(run)
        x, visible = u.features()
        stuffed = np.bincount(u.text_of, weights=visible * (model.predict(x) > 0.5), minlength=len(run)) if len(x) else np.zeros(len(run))
        total = np.bincount(u.text_of, weights=visible, minlength=len(run)) if len(x) else np.ones(len(run))
        out.append(stuffed / np.maximum(total, 1.0))
    return np.concatenate(out) if out else np.zeros(0)


def host(url: Column) -> Column:
    """Host of a page's address, without scheme and www; null for none."""
    h = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z]+://)?(?:www\.)?([^/\s?#:]+)", 1)
    return F.when(h == "", None).otherwise(h)


def lessons(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of the units of the weakly labelled ones of `texts`."""
    for run in parts(texts):
        u = Units(run)
        if u.n_units:
            x, visible = u.features()
            y = u.votes()[u.page_of]
            ok = (y >= 0) & (visible > 0)
            yield x[ok].astype(np.float32), y[ok]


def trained(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Trees:
    """Trees fitted on labelled units.  Spam pages hold ordinary sentences too:
    first trees drop the units that they contradict, and second ones are fitted
    on the rest."""
    if not (y == 1).any() or not (y == 0).any():
        return Trees().fit(np.zeros((1, len(FEATURES))), np.zeros(1))
    first = Trees(seed=seed).fit(x, y.astype(float)).predict(x)
    keep = (y == 0) | (first > 0.5)
    return Trees(seed=seed + 1).fit(x[keep], y[keep].astype(float))


def fit(docs: DataFrame, ident: str, text: str, sample: int = SAMPLE, units: tuple[int, int] = FIT_UNITS) -> Trees:
    """Trees fitted on the weakly labelled of at most `sample` pages, the first by
    a hash of their id, and of these on at most `units` units of ordinary and of
    spam pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in lessons(b.column(0).to_pylist()):
                key = [xxhash.xxh3_64_intdigest(r.tobytes()) >> 2 for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(key, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "k", "x"])

    d = docs.select(F.col(ident).alias("i"), F.col(text).alias("t")).filter(F.length("t") > 0)
    own = cut(bounded_sample(d, "i", sample).select("t").repartition(F.hash("t")).mapInArrow(run, "y int, k bigint, x binary"), "lessons")
    got = [r for y in (0, 1) for r in bounded_sample(own.filter(F.col("y") == y), "k", units[y]).select("y", "x").collect()]
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), len(FEATURES))
    return trained(x.astype(np.float64), np.array([r.y for r in got]))


def scored(docs: DataFrame, ident: str = "doc_id", text: str = "text", url: str = "page_url", sample: int = SAMPLE) -> DataFrame:
    """(id, host, page_score, host_rate, score, spam) of every page."""
    model = fit(docs, ident, text, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = page_scores(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["id", "host", "page_score"])

    kind = dict(docs.dtypes)[ident]
    p = docs.select(F.col(ident).alias("id"), host(F.col(url)).alias("host"), F.col(text)).mapInArrow(run, f"id {kind}, host string, page_score double")
    return smoothed(cut(p, "pages")).withColumnRenamed("id", ident)


def smoothed(p: DataFrame) -> DataFrame:
    """Page scores (id, host, page_score) with `host_rate`, the smoothed `score` and `spam`."""
    overall = float(p.agg(F.avg("page_score").alias("r")).first().r or 0.0)
    hosts = p.filter("host is not null").groupBy("host").agg(((F.sum("page_score") + F.lit(PRIOR * overall)) / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("host_rate"))
    j = p.join(small(hosts), "host", "left")
    score = F.when(F.col("host_rate").isNull(), F.col("page_score")).otherwise((1 - HOST) * F.col("page_score") + HOST * F.col("host_rate"))
    return j.withColumn("score", score).withColumn("spam", F.col("score") > 0.5)
