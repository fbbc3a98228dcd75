"""Problem 1: one form for texts that look the same.

Look-alike classes are the transitive closure, by union-find, of relations
between *strings* of code points: compatibility forms, canonical compositions,
look-alike letters, blanks, and characters without a glyph.  Each class is
represented by its member that is most frequent in the corpus (counted over
all rows), and texts are rewritten greedily, longest match first, by a
multi-pattern automaton.  Sequences of any number of marks, in any order, are
brought into canonical order and composed before and after each rewriting, so
that what rewriting brings together (a replaced letter and its marks) meets too.

Defined cases: a null text stays null; a text with nothing visible becomes the
empty string; runs of any blanks become one blank and none stays at the ends.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that share a glyph with a Latin letter.
LOOKALIKE_LETTERS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ѵ": "v", "ԍ": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin letters with the glyph of another
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ɡ": "g", "ɩ": "i", "ı": "i", "ʏ": "Y",
    # Cyrillic palochka
    "Ӏ": "I", "ӏ": "l",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W",
    "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # hyphens
    "‐": "-", "‑": "-", "﹣": "-",
}
# Chillu letters and the sequences that render as them.
CHILLU = {"ൺ": "ണ്‍", "ൻ": "ന്‍", "ർ": "ര്‍", "ൽ": "ല്‍", "ൾ": "ള്‍", "ൿ": "ക്‍"}
#: Compatibility tags whose decomposition has the same look.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
#: Part of all characters by which an ASCII member of a class counts more, so that a
#: disguise has to be common in the whole corpus to become the rule.
ASCII_PRIOR = 0.05
ROMAN = range(0x2160, 0x2180)
JOINERS = "‌‍"


def invisible(ch: str) -> bool:
    """Whether a code point has neither a glyph nor a width."""
    o = ord(ch)
    return (
        unicodedata.category(ch) == "Cf" and o not in range(0x600, 0x606) and o not in (0x6DD, 0x70F, 0x8E2)
        or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or 0x180B <= o <= 0x180F
        or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5)
    )


def expansion(ch: str) -> str | None:
    """The string that `ch` is a same-looking compatibility form of."""
    d = unicodedata.decomposition(ch)
    if not d:
        return None
    tag, _, rest = d.partition(" ")
    if tag[0] != "<":
        return None
    s = "".join(chr(int(x, 16)) for x in rest.split())
    if tag in SAME_LOOK or ord(ch) in ROMAN:
        return s
    if tag == "<compat>" and len(s) > 1 and (s.isascii() and s.isalpha() and ord(ch) >= 0xFB00 or set(s) == {"."}):
        return s
    return None


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = s = self.up[self.up[s]]
        return s

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for s in self.up:
            out.setdefault(self.find(s), []).append(s)
        return list(out.values())


def classes(alphabet: Iterable[str]) -> Classes:
    """Look-alike classes over the code points of `alphabet` and the fixed ones."""
    uf = Classes()
    chars = {*alphabet, *LOOKALIKE_LETTERS, *CHILLU}
    latin = {*LOOKALIKE_LETTERS.values()} | {chr(c) for c in range(0x21, 0x7F)}
    chars |= latin
    for a, b in (*LOOKALIKE_LETTERS.items(), *CHILLU.items()):
        uf.union(a, b)
    for ch in chars:
        if ch.isspace():
            uf.union(ch, " ")
        elif invisible(ch):
            uf.union(ch, "")
        elif e := expansion(ch):
            uf.union(ch, e)
    marks = [c for c in chars if unicodedata.combining(c)]
    for ch in chars:
        nfd = unicodedata.normalize("NFD", ch)
        if nfd != ch:
            uf.union(ch, nfd)
    # A letter that looks like a base letter, with a mark, looks like the composed letter.
    alike: dict[str, list[str]] = {}
    for ch in chars:
        if len(ch) == 1 and ch.isalpha():
            alike.setdefault(uf.find(ch), []).append(ch)
    for members in list(alike.values()):
        bases = [m for m in members if m in latin]
        for b in bases:
            for m in marks:
                whole = unicodedata.normalize("NFC", b + m)
                if len(whole) == 1:
                    for x in {*members, b}:
                        uf.union(x + m, whole)
    # So does any letter that looks like the base of a composed one, with a mark that looks like its mark.
    of: dict[str, list[str]] = {}
    for g in uf.groups():
        for m in g:
            of[m] = [x for x in g if len(x) == 1]
    for ch in chars:
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) == 2:
            for x in of.get(nfd[0], [nfd[0]]):
                for y in of.get(nfd[1], [nfd[1]]):
                    uf.union(x + y, ch)
    # Joiners are seen after a virama and between pictographs.
    for v in [c for c in chars if unicodedata.combining(c) == 9]:
        for j in JOINERS:
            uf.find(v + j)
    for p in [c for c in chars if unicodedata.category(c) == "So"]:
        uf.find(p + "‍")
    return uf


def rewrites(counts: dict[str, int]) -> dict[str, str]:
    """Map each class member to its representative: the most frequent member by
    `counts`, where ASCII has a prior in proportion to the corpus (ties: the shorter, then the first by code point; a class with the
    empty string is represented by it).  Identities of longer strings stay in
    the map where they must be protected from shorter matches."""
    uf = classes(k for k in counts if len(k) == 1)
    prior = ASCII_PRIOR * sum(n for k, n in counts.items() if len(k) == 1) + 1e-9
    out: dict[str, str] = {}
    for members in uf.groups():
        if "" in members:
            rep = ""
        elif " " in members:
            rep = " "
        else:
            rep = min(members, key=lambda s: (-counts.get(s, 0) - prior * s.isascii(), len(s), s))
        for m in members:
            if m and (m != rep or len(m) > 1 and not m.isascii()):
                out[m] = rep
    return out


def composed(t: str) -> str:
    """The text with marks in canonical order and composed."""
    return t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)


_MARKS: list[np.ndarray] = []


def marks() -> np.ndarray:
    """For each code point, whether it is a combining mark; made once in each worker."""
    if not _MARKS:
        is_mark = np.zeros(0x110000, bool)
        is_mark[[c for c in (*range(0x300, 0x20000), *range(0xE0000, 0xE0200)) if unicodedata.combining(chr(c))]] = True
        _MARKS.append(is_mark)
    return _MARKS[0]


class Rewriter:
    """Greedy leftmost-longest rewriting with an automaton over all patterns."""

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.table = table
        self.auto = ahocorasick.Automaton()
        for k, v in table.items():
            self.auto.add_word(k, (len(k), v))
        self.auto.make_automaton()
        self.plain = not any(k.isascii() and not k.isspace() for k in table)
        gone = "".join(re.escape(k) for k, v in table.items() if not v)
        self.gaps = re.compile(f"[{gone}]") if gone else None
        # Every rewritten pattern ends in one of these; most texts hold none of them.
        ends = {k[-1] for k, v in table.items() if k != v}
        self.ends = re.compile("[" + "".join(map(re.escape, sorted(ends))) + "]") if ends else None

    def once(self, t: str) -> str:
        out, pos = [], 0
        for end, (n, rep) in self.auto.iter_long(t):
            start = end - n + 1
            if start > pos:
                out.append(t[pos:start])
            out.append(rep)
            pos = end + 1
        if not pos:
            return t
        out.append(t[pos:])
        return "".join(out)

    def __call__(self, t: str) -> str:
        if not (self.plain and t.isascii()):
            t = composed(t)
            if self.ends and self.ends.search(t):
                u = composed(self.once(t))
                # Marks may meet their letters once what stood between is gone.
                t = composed(self.once(u)) if u != t else u
        return " ".join(t.split())


_REWRITERS: dict[int, Rewriter] = {}


def rewriter(table: dict[str, str]) -> Rewriter:
    """Rewriter of `table`, built once in each Python worker."""
    key = hash(frozenset(table.items()))
    if key not in _REWRITERS:
        _REWRITERS.clear()
        _REWRITERS[key] = Rewriter(table)
    return _REWRITERS[key]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    singles = np.zeros(0x110000, np.int64)
    pairs: dict[int, int] = {}
    strings: dict[str, int] = {}
    expanded = sorted({e for c in range(0xFB00, 0xFB07) if (e := expansion(chr(c)))})
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        if not texts:
            continue
        whole = composed("\n".join(texts))
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        singles += np.bincount(cp, minlength=0x110000)
        for s in expanded:
            strings[s] = strings.get(s, 0) + whole.count(s)
        hit = np.flatnonzero(marks()[cp[1:]])
        if len(hit):
            keys, n = np.unique((cp[hit].astype(np.int64) << 21) | cp[hit + 1], return_counts=True)
            for k, m in zip(keys.tolist(), n.tolist()):
                pairs[k] = pairs.get(k, 0) + m
    for k, m in pairs.items():
        strings[chr(k >> 21) + chr(k & 0x1FFFFF)] = m
    for c in np.flatnonzero(singles).tolist():
        strings[chr(c)] = int(singles[c])
    strings = {k: v for k, v in strings.items() if v and not any(0xD800 <= ord(c) < 0xE000 for c in k)}
    yield pa.RecordBatch.from_pydict({"s": pa.array(list(strings), pa.string()), "n": pa.array(list(strings.values()), pa.int64())})


def corpus_counts(df: DataFrame, text: str) -> dict[str, int]:
    """Counts of code points, of letters with a mark, and of the expansions of
    ligatures over all rows.  The result is bounded by the code points of
    Unicode and their compositions, whatever the corpus."""
    rows = df.select(text).mapInArrow(_count, "s string, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {r.s: r.n for r in rows}


def lookalike_table(df: DataFrame, text: str = "raw_text") -> dict[str, str]:
    """Rewriting table fitted on all texts of `df`."""
    return rewrites(corpus_counts(df, text))


def canonical(df: DataFrame, text: str = "raw_text", out: str = "canonical_text", table: dict[str, str] | None = None) -> DataFrame:
    """Add `out`: the consistent form of `text`.  Other columns, whatever their
    names, pass through; an existing column `out` is replaced."""
    table = lookalike_table(df, text) if table is None else table

    @F.pandas_udf("string")
    def form(s):  # noqa: ANN001, ANN202
        f = rewriter(table)
        return s.map(f, na_action="ignore")

    return df.withColumn(out, form(F.col(text)))


def _hash16(t: str) -> bytes:
    return xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))


def form_keys(df: DataFrame, ident: str, text: str, table: dict[str, str]) -> DataFrame:
    """(id, raw, form): 128-bit keys of the text and of its consistent form,
    for rows with something visible."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rewriter(table)
        for b in batches:
            ids, raws, forms = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and i is not None and (u := f(t)):
                    ids.append(i)
                    raws.append(_hash16(t))
                    forms.append(raws[-1] if u == t else _hash16(u))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "raw": pa.array(raws, pa.binary()), "form": pa.array(forms, pa.binary())})

    return df.select(F.col(ident).cast("string"), text).mapInArrow(keys, "id string, raw binary, form binary")


def alike_pairs(df: DataFrame, ident: str = "message_id", text: str = "raw_text", table: dict[str, str] | None = None) -> DataFrame:
    """Pairs (a < b) of ids whose texts look the same but are different
    sequences of code points.

    Forms with one spelling are dropped by an aggregate before anything is
    joined.  Spellings, not rows, are then paired within a form, so that a
    form held by a third of all rows costs its output and no more; rows join
    to spelling pairs by equality, where skewed spellings are split by AQE.
    """
    table = lookalike_table(df, text) if table is None else table
    keys = form_keys(df, ident, text, table)
    several = keys.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("form")
    rows = keys.join(several, "form").distinct()
    kinds = rows.select("form", "raw").distinct()
    pairs = kinds.alias("x").join(kinds.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.raw") < F.col("y.raw")))
    pairs = pairs.select(F.col("x.raw").alias("ra"), F.col("y.raw").alias("rb"))
    one = rows.select(F.col("raw").alias("ra"), F.col("id").alias("i"))
    two = rows.select(F.col("raw").alias("rb"), F.col("id").alias("j"))
    out = pairs.join(one, "ra").join(two, "rb").filter("i <> j")
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def alike_classes(df: DataFrame, ident: str = "message_id", text: str = "raw_text", table: dict[str, str] | None = None) -> DataFrame:
    """(id, class_id, spelling_id): every row with something visible, once, by the
    form that its text has and by its own sequence of code points.  Rows of one
    class and different spellings are the pairs of `alike_pairs`."""
    keys = form_keys(df, ident, text, lookalike_table(df, text) if table is None else table).distinct()
    return keys.select(F.col("id").alias(ident), F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("raw")).alias("spelling_id"))


def blank(c: Column) -> Column:
    """Whether a text is null or has only blanks (no rewriting needed)."""
    return c.isNull() | (F.trim(c) == "")
