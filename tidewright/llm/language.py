"""Problem 6: the language of each message and of each stretch of a mixed one.

A byte convolutional network (filters of several widths over byte embeddings,
max pooling, softmax) is trained in numpy on clauses of labelled messages and
applied to batched windows of a fixed number of bytes.  Labels are noisy, so a
first network drops the clauses that it clearly contradicts and a second one is
trained on the rest.  At inference each filter is a sum of table rows, one for
each byte, and equal pieces of text are judged once in each worker.

Texts are cut into sentences, and these into pieces at commas, dashes and
changes of script.  A sentence has the language of its windows' joint
probability; a piece of some words that clearly speaks for another language
counts as a clause of its own.  The network has a class of its own for names
(trained on lists of place names), whose share speaks for no language.

Defined cases: null texts and texts without words have no language; a text that
speaks clearly for none gets its most probable one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.lookalike import lookalike_table, rewriter
from tidewright.llm.personal import details
from tidewright.session import bounded_sample

LANGS = ("en", "hi", "ml")
# Spellings of labels, without region and case.
LABELS = {
    "en": "en", "eng": "en", "english": "en", "hi": "hi", "hin": "hi", "hindi": "hi", "ml": "ml", "mal": "ml", "malayalam": "ml",
    "mixed": "mixed", "mix": "mixed", "mul": "mixed", "multiple": "mixed",
}
#: Labelled messages that the network is trained on at most (the first by a hash of their id).
SAMPLE = 2000
#: Lists of names that the class of names is trained on.
NAME_LISTS = 3000
WINDOW = 48
DIM, FILTERS, WIDTHS = 8, 32, (2, 3, 5)
EPOCHS, STEPS, BATCH, RATE = 6, 400, 64, 0.004
#: Joint probability from which a sentence, and a piece within one, counts as a clause of a language.
SURE, SURE_PIECE, PIECE_WORDS = 0.80, 0.95, 3

SENTENCE = re.compile(r"(?<=[.!?।])\s+|\s+[-–—]\s+|\n+")
#: Commas, and changes between Latin and Indic words.
PIECE = re.compile(r",\s+|(?<=[a-z.:?!,])\s+(?=[ऀ-ॿഀ-ൿ])|(?<=[ऀ-ॿഀ-ൿ.,])\s+(?=[a-z])")
WORD = re.compile(r"[^\W\d_][^\s\d_.,!?;:()\-#@/।]+")
NUMBER = re.compile(r"\d+")
#: Codes, addresses and numbers: no words of a language.
CODE = re.compile(r"\S*\d\S*|\S*[@#/]\S*|\b(?:ref|slip|token|case|form no|sos|http\S*)\b:?")


# Marks of texts that may hold a detail whose words are a name's
# (addresses, spelt numbers, identity numbers).
DETAIL = (
    "aadhaar", "voter", "passport", "house ", "door no", "flat ", "h.no", "@", "(at)", "[at]", " dot ", " pin ",
    "zero ", "one ", "two ", "three ", "four ", "five ", "six ", "seven ", "eight ", "nine ",
)


def label_of(c: Column) -> Column:
    """en, hi, ml or mixed, or null where a label names no language."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(base == k, v).otherwise(out)
    return out


def sentences(t: str) -> list[list[str]]:
    """Pieces of each sentence of a text of consistent form, lower-cased, with 0
    for numbers and nothing for personal details; sentences of few words beside a
    detail are left out."""
    low = t.lower()
    if any(x in low for x in DETAIL):
        out, pos = [], 0
        for a, b, _ in details(t):
            out += [t[pos:a], "\x01"]
            pos = b
        low = "".join([*out, t[pos:]]).lower()
    whole = []
    for s in SENTENCE.split(NUMBER.sub("0", low)):
        if not s:
            continue
        if "\x01" in s:
            if len(WORD.findall(s)) < 4:
                continue
            s = s.replace("\x01", "0")
        s = s.strip(" .,!?।:-")
        whole.append(s.split(", ") if s.isascii() else PIECE.split(s))
    return whole


def words_of(piece: str) -> int:
    """Words of a piece, without codes and numbers."""
    return len(WORD.findall(CODE.sub(" ", piece)))


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of WINDOW bytes, and the index of the text of each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    many = np.array([max(1, -(-len(r) // WINDOW)) for r in raw], np.int64)
    whole = b"".join(r.ljust(int(m) * WINDOW, b"\0") for r, m in zip(raw, many))
    return np.frombuffer(whole, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(raw)), many)


class ByteNet:
    """Byte embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (256, DIM)), "v": r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(LANGS) + 1)), "c": np.zeros(len(LANGS) + 1)}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.table: list[np.ndarray] | None = None

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        p, n = self.p, len(x)
        e = p["e"][x]
        keep, hs = {}, []
        for w in WIDTHS:
            u = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * DIM)
            z = u @ p[f"w{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            h = np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0], 0)
            keep[w] = (u, at, h)
            hs.append(h)
        h = np.concatenate(hs, 1)
        s = h @ p["v"] + p["c"]
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"v": h.T @ q, "c": q.sum(0), "e": np.zeros_like(p["e"])}
        dh = q @ p["v"].T
        for k, w in enumerate(WIDTHS):
            u, at, hw = keep[w]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS] * (hw > 0)
            chosen = u[np.arange(n)[:, None], at]
            g[f"w{w}"] = np.einsum("nf,nfd->df", d, chosen)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * p[f"w{w}"].T[None]
            for o in range(w):
                np.add.at(g["e"], x[np.arange(n)[:, None], at + o], back[:, :, o * DIM : (o + 1) * DIM])
        state["t"] = t = state.get("t", 0) + 1
        for k, gk in g.items():
            m, v = state.get(k, (0.0, 0.0))
            state[k] = m, v = 0.9 * m + 0.1 * gk, 0.999 * v + 0.001 * gk * gk
            p[k] -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> ByteNet:
        r, state = np.random.default_rng(seed), {}
        epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(x))))
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                j = order[i : i + BATCH]
                self.step(x[j], y[j], state, RATE * (0.5 if epoch >= 0.6 * epochs else 1.0))
        self.table = None
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores of windows: each filter is a sum of table rows, one for each byte."""
        if self.table is None:
            f = FILTERS
            self.table = []
            for o in range(max(WIDTHS)):
                cols = [self.p["e"] @ self.p[f"w{w}"][o * DIM : (o + 1) * DIM] + (self.p[f"b{w}"] if o == 0 else 0) for w in sorted(WIDTHS, reverse=True) if w > o]
                self.table.append(np.ascontiguousarray(np.concatenate(cols, 1), np.float32))
            ws = sorted(WIDTHS, reverse=True)
            self.v = np.concatenate([self.p["v"][list(WIDTHS).index(w) * f : (list(WIDTHS).index(w) + 1) * f] for w in ws])
        out = np.empty((len(x), len(LANGS) + 1), np.float32)
        ws = sorted(WIDTHS, reverse=True)
        for i in range(0, len(x), 64):
            b = x[i : i + 64]
            acc = self.table[0][b]
            for o in range(1, max(WIDTHS)):
                t = self.table[o]
                acc[:, : WINDOW - o, : t.shape[1]] += t[b[:, o:]]
            h = [acc[:, : WINDOW - w + 1, k * FILTERS : (k + 1) * FILTERS].max(1) for k, w in enumerate(ws)]
            out[i : i + 64] = np.maximum(np.concatenate(h, 1), 0) @ self.v + self.p["c"]
        return out


def evidence(s: np.ndarray) -> np.ndarray:
    """Log probabilities of the languages; the share of names is spread evenly."""
    q = np.exp(s - s.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    return np.log(q[:, :-1] + q[:, -1:] / len(LANGS) + 1e-4)


def name_lists(names: list[str], n: int = NAME_LISTS, seed: int = 3) -> list[str]:
    """Pieces as names alone make them."""
    if not names:
        return []
    r = np.random.default_rng(seed)
    out = []
    for i in r.integers(0, len(names), n):
        x = names[i].lower()
        out.append(x.split()[0] if r.random() < 0.25 else x)
    return out


def train(texts: list[str], labels: list[str], table: dict[str, str], names: list[str] | None = None) -> ByteNet:
    """A network for pieces of clauses, from texts with noisy labels and from names."""
    f = rewriter(table)
    pieces, y = [], []
    for t, lab in zip(texts, labels):
        for s in sentences(f(t)):
            own = [p for p in s if words_of(p) >= PIECE_WORDS]  # shorter ones are mostly names
            pieces += own
            y += [LANGS.index(lab)] * len(own)
    if not pieces:
        return ByteNet()
    extra = name_lists([f(n) for n in names or []])
    x, of = windows(pieces + extra)
    y = np.array(y + [len(LANGS)] * len(extra))[of]
    first = ByteNet().fit(x, y)
    s = first.logits(x)
    q = np.exp(s - s.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    keep = q[np.arange(len(y)), y] > 0.3
    return ByteNet(6).fit(x[keep], y[keep]) if keep.any() else first


def fitted(df: DataFrame, ident: str, text: str, label: str, table: dict[str, str], names: list[str] | None = None, sample: int = SAMPLE) -> ByteNet:
    """Network fitted on at most `sample` rows whose label names one language."""
    d = df.select(F.col(ident).alias("i"), F.col(text).alias("t"), label_of(F.col(label)).alias("l"))
    d = d.filter(F.col("l").isin(*LANGS) & (F.length("t") > 0))
    rows = bounded_sample(d, "i", sample).select("t", "l").collect()
    return train([r.t for r in rows], [r.l for r in rows], table, names)


def judge(texts: list[str | None], net: ByteNet, table: dict[str, str], known: dict[str, tuple] | None = None) -> list[list[tuple[str, str, float]]]:
    """Segments (text, language, confidence) of each text; the language is ""
    where a segment speaks clearly for none.  `known` keeps the words and the
    evidence of pieces from call to call."""
    f = rewriter(table)
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    plan: list[list[list[str]]] = [sentences(f(t)) if t else [] for t in texts]
    fresh = list({p for own in plan for s in own for p in s if p not in known})
    count = [words_of(p) for p in fresh]
    known.update((p, None) for p, n in zip(fresh, count) if not n)
    fresh, count = [p for p, n in zip(fresh, count) if n], [n for n in count if n]
    if fresh:
        x, of = windows(fresh)
        score = np.zeros((len(fresh), len(LANGS)))
        np.add.at(score, of, evidence(net.logits(x)))
        # One or two words are mostly a name, and say little of the sentence.
        score *= np.where(np.array(count) >= PIECE_WORDS, 1.0, 0.3)[:, None]
        for p, n, row in zip(fresh, count, score.tolist()):
            known[p] = (*row, n)
    out = []
    for own in plan:
        segs: list[tuple[str, str, float]] = []
        total = [0.0, 0.0, 0.0]
        for pieces in own:
            rows = [(p, r) for p in pieces if (r := known[p])]
            if not rows:
                continue
            a = b = c = n = 0
            for _, r in rows:
                a, b, c, n = a + r[0], b + r[1], c + r[2], n + r[3]
            total = [total[0] + a, total[1] + b, total[2] + c]
            k, top = likeliest((a, b, c))
            whole = LANGS[k] if top >= SURE and (k == 2 or n >= PIECE_WORDS) else ""
            parts: list[list] = []
            for p, r in rows:
                lang, conf = whole, top
                if len(rows) > 1 and r[3] >= PIECE_WORDS:
                    j, alone = likeliest(r)
                    if j != k and alone >= SURE_PIECE:
                        lang, conf = LANGS[j], alone
                if parts and parts[-1][1] == lang:
                    parts[-1][0] += ", " + p
                else:
                    parts.append([p, lang, conf])
            segs += [tuple(p) for p in parts]
        if segs and not any(s[1] for s in segs):
            k, top = likeliest(total)
            segs = [(s[0], LANGS[k], top) for s in segs]
        out.append(segs)
    return out


def likeliest(row) -> tuple[int, float]:  # noqa: ANN001
    """Index and probability of the largest of three log scores."""
    a, b, c = row[0], row[1], row[2]
    k = 0 if a >= b and a >= c else 1 if b >= c else 2
    m = (a, b, c)[k]
    return k, 1.0 / (math.exp(a - m) + math.exp(b - m) + math.exp(c - m))


def identified(df: DataFrame, ident: str = "message_id", text: str = "raw_text", label: str = "detected_language", keep: list[str] | None = None, table: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """`df` with `segments` (text, lang, confidence), `langs` (sorted) and
    `confidence` (the mean over segments, by length)."""
    table = lookalike_table(df, text) if table is None else table
    net = fitted(df, ident, text, label, table, names)
    kinds = dict(df.dtypes)
    cols = [c for c in (keep or [ident, label]) if c not in ("langs", "confidence", "segments")]
    seg = pa.list_(pa.struct([("text", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            got = judge(b.column(0).to_pylist(), net, table, known)
            langs = [sorted({s[1] for s in g if s[1]}) for g in got]
            conf = [sum(s[2] * len(s[0]) for s in g) / max(1, sum(len(s[0]) for s in g)) if g else None for g in got]
            segs = [[{"text": s[0], "lang": s[1] or None, "confidence": s[2]} for s in g] for g in got]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i + 1) for i in range(len(cols))), pa.array(langs, pa.list_(pa.string())), pa.array(conf, pa.float64()), pa.array(segs, seg)],
                names=[*cols, "langs", "confidence", "segments"],
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "langs array<string>", "confidence double", "segments array<struct<text:string,lang:string,confidence:double>>"])
    return df.select(F.col(text), *cols).mapInArrow(run, schema)


def mislabelled(df: DataFrame, ident: str = "message_id", text: str = "raw_text", label: str = "detected_language", table: dict[str, str] | None = None, names: list[str] | None = None) -> DataFrame:
    """(id, lang): the languages of each text whose label is missing or wrong."""
    d = identified(df, ident, text, label, [ident, label], table, names).filter(F.size("langs") > 0)
    right = F.when(F.size("langs") > 1, F.lit("mixed")).otherwise(F.element_at("langs", 1))
    return d.filter(~right.eqNullSafe(label_of(F.col(label)))).select(ident, F.explode("langs").alias("lang")).distinct()
