"""Problem 2: personal details in free text, by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digits and number
words, identifier cues, name cues in English, Hindi and Malayalam, titles, house
and street words) in the consistent form of each text; a deterministic parser
at each anchor expands and validates the boundaries of one detail.  Parsers look
as far as a token, a few tokens, a clause or a run of digits goes, never a number
of characters, and nothing scans the text for details without an anchor.  Spans
are mapped back, so that the text comes out as it came in but for the
placeholders.

Defined cases: a null text gives null and no details; overlapping details are
resolved in favour of the earlier start, then the longer one; case, form and
boat numbers, coordinates, dates, short helplines and landmarks are kept.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.lookalike import Rewriter, lookalike_table, rewriter

PLACEHOLDER = {
    "email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>",
    "street_address": "<STREET_ADDRESS>", "person_name": "<PERSON_NAME>",
}

# Cues after which an identity number may stand.
ID_CUES = [
    "aadhaar", "aadhar", "adhaar", "identity number", "identity no", "id number", "voter", "epic", "passport", "ration card",
    "pan card", "licence", "license", "आधार", "पहचान", "राशन कार्ड", "वोटर", "मतदाता", "पासपोर्ट", "ആധാർ", "റേഷൻ കാർഡ്", "വോട്ടർ",
    "പാസ്പോർട്ട്", "പാസ്‌പോർട്ട്", "തിരിച്ചറിയൽ",
]
# Cues before a name.
NAME_BEFORE = [
    "my name is", "name is", "this is", "ask for", "contact", "last saw", "informed by", "is called", "mera naam", "naam hai",
    "मेरा नाम", "मेरी नाम", "നാമം", "പേര്", "reported by", "speak to",
]
# Cues after a name.
NAME_AFTER = [
    "has not answered", "has not called", "and her mother", "and his mother", "and her father", "and his father", "ka kuch pata", "ki khabar",
    "ki kuch khabar", "se baat", "ne yeh khabar", "ne khabar", "aur unki maa", "aur unke pita", "का कुछ पता", "की खबर", "से बात", "ने यह खबर",
    "ने यह ख़बर", "और उनकी माँ", "और उनके पिता", "എവിടെയെന്ന്",
]
# Cues that no other noun follows than a name: one word is enough.
NAME_CERTAIN = ["my name is", "mera naam", "naam hai", "मेरा नाम", "मेरी नाम", "is called"]
# Words after the name that make "this is" a cue.
SPEAKING = re.compile(r"[\s,]*(?:speaking|calling|here)\b")
SCHEMES = ["mailto:", "tel:", "sms:", "callto:"]
TITLES = ["mr", "mrs", "ms", "dr", "smt", "shri", "sri", "kumari", "श्री", "श्रीमती", "डॉ"]
STREETS = ["road", "street", "lane", "avenue", "gali", "marg", "nagar", "रोड", "गली", "റോഡ്"]
HOUSES = ["house", "door", "flat", "h.no", "h no", "hno", "मकान", "h. no"]
MAIL_AT = ["@", "(at)", "[at]", "{at}", " at "]

W = r"[^\W\d_][^\s\d_.,!?;:()<>\[\]।/\-]*"
TITLE = r"(?:" + "|".join(TITLES) + r")\b\.?"
#: Words that begin no name after a cue, or end none before one.
NOT_NAMES = frozenset(
    "the a an of on in at to for with and or from is are was were be been we i you he she it they this that there their our my your his her "
    "water food boat help rescue people persons family families children camp ward road house houses control room doctor nurse team crew "
    "nobody somebody anyone everyone us them me no not now again also just really urgently please still only quickly alone sir madam hai hain ho "
    "ka ki ke se ne par me mein aur koi kuch sab log lost relatives about near behind who what where when how so but if as by "
    "approach bund wali wale waali toward from next road lane path side near beside opposite under over through by past roof upper floor terrace sms phone call number ref slip token case form update urgent sos".split()
)
FILLER = r"(?:(?:really|urgently|now|again|also|just|please|still|only|quickly|alone|very|bhi|yahan|abhi|bahut|zara|jaldi|always|here)\s+)?"
FORWARD = re.compile(rf"[\s:\-]+{FILLER}((?:{TITLE}\s+)?(?:[^\W\d_]\.?\s+)?{W}(?:\s+[^\W\d_]\b\.?(?=\s+\w))?(?:\s+{W})?)", re.I)
BACKWARD = re.compile(rf"((?:{TITLE}\s+)?(?:{W}\s+)?(?:[^\W\d_]\b\.?\s+)?{W}\.?)\s+{FILLER}$", re.I)
TITLED = re.compile(rf"({TITLE}\s+(?:[^\W\d_]\.\s+)?{W}(?:\s+[^\W\d_]\.)?(?:\s+{W})?)", re.I)
CLOSERS = frozenset("hai hain है हैं ആണ് ആണു at on from speaking and has is ka ki se ne aur का की से ने और par who was in with എന്ന് എവിടെയെന്ന് or to please".split())

JOINED = frozenset("0123456789 -./()")
PHONE = re.compile(
    r"(?<![\w./\-])(?:\+ ?91[ \-]?\d{5}[ \-]?\d{5}|0091[ \-]?\d{5}[ \-]?\d{5}|\(0\d{2,4}\) ?\d{3,4}[ \-]?\d{3,4}|0\d{3}[ \-]\d{3}[ \-]\d{4}"
    r"|0\d{2,3}-\d{6,8}|[5-9]\d{2}[. \-]\d{3}[. \-]\d{4}|[5-9]\d{4}[ \-]?\d{5}|\+\d{1,3}[ \-]?\d{6,12}|0[5-9]\d{9})(?![\d\w/]|-\d)"
)
NUMBER_WORDS = "zero one two three four five six seven eight nine oh double triple".split()
SPELLED = re.compile(r"(?:(?:" + "|".join(NUMBER_WORDS) + r")\b[\s,\-]*){7,}", re.I)
ID12 = re.compile(r"(?<![\w\-+])\d{4}([ \-])\d{4}\1\d{4}(?![\w]|-\d)")
CLAUSE = re.compile(r"[.!?।,]\s")
ID_SHAPE = re.compile(
    r"(?<![A-Za-z0-9])(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}|(?:[A-Za-z]{2}[ \-])?\d{4}[ \-/]?\d{6}|[A-Za-z]{3}[ \-]?\d{7}|[A-Za-z][ \-]?\d{7}"
    r"|[A-Za-z]{5}\d{4}[A-Za-z])(?!\w)"
)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-")
ADDRESS = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z][A-Za-z0-9\-]*)+")
DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\s*[(\[{]dot[)\]}]\s*|\s+dot\s+|\.)[A-Za-z][A-Za-z0-9\-]*)+", re.I)
HOUSE = re.compile(
    rf"(?:house|door|flat|h\.? ?no|मकान)\b\.?(?:\s*(?:no|number|नंबर)\b\.?)?\s*(?:\d+[A-Za-z]?(?:[/\-]\d*\w*)?)\s*,?(?:\s*{W}){{1,4}}?(?:\s*,\s*{W}(?:\s+{W}){{0,3}}?)?"
    rf"\s+(?:{'|'.join(STREETS)})\b(?:\s*,\s*\d+(?:st|nd|rd|th) floor)?(?:\s*,?\s*pin\s*\d{{6}})?",
    re.I,
)
HOUSE_ONLY = re.compile(r"(?:door\s*no|h\.? ?no|flat|मकान)\b\.?\s*(?:\d+[A-Za-z]?(?:[/\-]\d*\w*)?)", re.I)
STREET_LEFT = re.compile(rf"(?<![\w/\-#.])(\d{{1,4}}[A-Za-z]?(?:[/\-]\d+[A-Za-z]?)?),?\s+((?:{W}\s+){{1,4}})$", re.I)
STREET_RIGHT = re.compile(r"\s*,?\s*(?:\d+(?:st|nd|rd|th) floor)?\s*,?\s*(?:pin\s*:?\s*\d{6})?", re.I)
NUMBER = re.compile(r"\d")
PIN = re.compile(r"\s*,?\s*pin\s*:?\s*\d{6}", re.I)


def _automaton():  # noqa: ANN202
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds: dict[str, set[str]] = {}
    for kind, words in (("id", ID_CUES), ("before", NAME_BEFORE), ("after", NAME_AFTER), ("street", STREETS), ("house", HOUSES), ("mail", MAIL_AT)):
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    for t in TITLES:
        kinds.setdefault(t + " ", set()).add("title")
        kinds.setdefault(t + ".", set()).add("title")
    for w in NUMBER_WORDS:
        kinds.setdefault(w, set()).add("spelled")
    for d in "0123456789":
        kinds.setdefault(d, set()).add("digit")
    for w in SCHEMES:
        kinds.setdefault(w, set()).add("scheme")
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(sorted(k))))
    a.make_automaton()
    return a


_AUTO = None


def _bounded(s: str, i: int, j: int) -> bool:
    return not (i > 0 and s[i - 1].isalpha() and s[i].isalpha() or j < len(s) and s[j].isalpha() and s[j - 1].isalpha())


def _left(s: str, i: int, tokens: int) -> int:
    """Where the last `tokens` tokens before position i begin."""
    for _ in range(tokens):
        while i > 0 and s[i - 1] == " ":
            i -= 1
        i = s.rfind(" ", 0, i) + 1
        if not i:
            break
    return i


def _run(s: str, i: int) -> tuple[int, int]:
    """The run of digits and what joins them about position i, from a digit, + or ( to a digit."""
    j = i + 1
    while j < len(s) and s[j] in JOINED:
        j += 1
    while not s[j - 1].isdigit():
        j -= 1
    if i and s[i - 1] in "+(":
        i -= 1
    elif i > 1 and s[i - 1] == " " and s[i - 2] == "+":
        i -= 2
    return i, j


def verhoeff(digits: str) -> bool:
    """Whether the last digit is the check digit of the others: sums in the group
    of symmetries of a pentagon, each place turned by a power of one permutation."""
    turn, c = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], 0
    for k, d in enumerate(reversed(digits)):
        x = int(d)
        for _ in range(k % 8):
            x = turn[x]
        c = (c + x) % 5 if c < 5 and x < 5 else 5 + (c + x - 5) % 5 if c < 5 else 5 + (c - 5 - x) % 5 if x < 5 else (c - x) % 5
    return c == 0


def _clean_name(words: list[str], certain: bool = False) -> list[str]:
    """Name tokens up to a closing word; empty if no name stands there.  After a
    cue that is certain, one word of two letters is a name."""
    out = []
    for w in words:
        if w.lower().strip(".") in CLOSERS:
            break
        out.append(w)
    while out and out[-1].lower().strip(".") in NOT_NAMES:
        out.pop()
    core = [w for w in out if w.lower().strip(".") not in TITLES]
    if not core or core[0].lower().strip(".") in NOT_NAMES and len(core[0].strip(".")) > 1:
        return []
    if certain:
        return out if max(len(w.strip(".")) for w in core) >= 2 else []
    return out if max(len(w.strip(".")) for w in core) >= 4 and len(core) >= 2 else []


def _name_forward(s: str, at: int, certain: bool = False) -> tuple[int, int] | None:
    m = FORWARD.match(s, at)
    if not m:
        return None
    words = m.group(1).split()
    kept = _clean_name(words, certain)
    if not kept:
        return None
    start, end = m.start(1), m.start(1)
    for w in kept:
        end = s.index(w, end) + len(w)
    # An initial that the pattern ended on belongs to the name, with what follows it.
    more = re.compile(rf"\s+{W}").match(s, end) if len(kept[-1].strip(".")) == 1 else None
    return start, more.end() if more else end


def _name_backward(s: str, at: int) -> tuple[int, int] | None:
    base = _left(s, at, 6)  # a title, three names, an initial and a filler
    m = BACKWARD.search(s[base:at])
    if not m:
        return None
    words = m.group(1).split()
    while len(words) > 1 and words[0].lower().strip(".") in NOT_NAMES and len(words[0].strip(".")) > 1:
        words.pop(0)
    last = words[-1].strip(".").lower()
    core = [w for w in words if w.lower().strip(".") not in TITLES]
    if not core or len(last) < 4 or last in NOT_NAMES or len(core) < 2:
        return None
    end = base + m.end(1)
    start = base + m.start(1)
    return s.index(words[0], start), end


def _numbers(s: str, a: int, b: int, found: list[tuple[int, int, str]]) -> None:
    """Identity and phone numbers in one run of digits."""
    for m in ID12.finditer(s, a, min(len(s), b + 2)):
        found.append((m.start(), m.end(), "id_number"))
    for m in PHONE.finditer(s, a, min(len(s), b + 2)):
        found.append((m.start(), m.end(), "phone"))
    if b - a == 12 and s[a:b].isdigit() and s[a] in "23456789" and not (a and (s[a - 1].isalnum() or s[a - 1] in "-/.")) and not s[b : b + 1].isalnum():
        # Without groups and cue, the check digit tells; a number after the country's code is a phone's.
        if verhoeff(s[a:b]) and not (s[a : a + 2] == "91" and s[a + 2] in "56789"):
            found.append((a, b, "id_number"))


def details(s: str) -> list[tuple[int, int, str]]:
    """Details in a text of consistent form: (start, end, type), in order."""
    global _AUTO
    if _AUTO is None:
        _AUTO = _automaton()
    low = s.lower()
    if len(low) != len(s):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    found: list[tuple[int, int, str]] = []
    seen = spelled = 0  # ends of the run of digits and of number words parsed last
    for end, (n, kinds) in _AUTO.iter(low):
        i, j = end - n + 1, end + 1
        for kind in kinds:
            if kind == "digit":
                if i < seen:
                    continue
                a, seen = _run(s, i)
                if seen - a >= 10:
                    _numbers(s, a, seen, found)
            elif kind == "mail":
                k = j
                while n > 1 and k < len(s) and s[k] == " ":
                    k += 1
                right = DOMAIN.match(s, k)
                if not right or low[i:j] == " at " and " dot " not in low[k : right.end()]:
                    continue
                e = i
                while n > 1 and e and s[e - 1] == " ":
                    e -= 1
                a = e
                while a and s[a - 1] in LOCAL:
                    a -= 1
                while a < e and s[a] in ".+-":
                    a += 1
                if a < e:
                    found.append((a, right.end(), "email"))
            elif kind == "scheme":
                if m := ADDRESS.match(s, j):
                    found.append((m.start(), m.end(), "email"))
            elif kind == "id":
                clause = CLAUSE.search(s, j)
                if m := ID_SHAPE.search(s, j, clause.start() if clause else len(s)):
                    found.append((m.start(), m.end(), "id_number"))
            elif not _bounded(low, i, j):
                continue
            elif kind == "spelled":
                if i >= spelled and (m := SPELLED.match(s, i)):
                    spelled = m.end()
                    found.append((i, i + len(m.group().rstrip(" ,-")), "phone"))
            elif kind == "before":
                r = _name_forward(s, j, low[i:j] in NAME_CERTAIN)
                if r and (low[i:j] != "this is" or SPEAKING.match(low, r[1])):
                    found.append((*r, "person_name"))
            elif kind == "after":
                if r := _name_backward(s, i):
                    found.append((*r, "person_name"))
            elif kind == "title":
                m = TITLED.match(s, i)
                if m and (kept := _clean_name(m.group(1).split())):
                    e = i
                    for w in kept:
                        e = s.index(w, e) + len(w)
                    found.append((i, e, "person_name"))
            elif kind == "house":
                m = HOUSE.match(s, i) or HOUSE_ONLY.match(s, i)
                if m and re.search(r"\d", m.group()):
                    e = m.end()
                    if p := PIN.match(s, e):
                        e = p.end()
                    found.append((i, e, "street_address"))
            elif kind == "street":
                base = _left(s, i, 6)  # a number, up to four words, and what is glued to them
                if not NUMBER.search(s, base, i):
                    continue
                m = STREET_LEFT.search(s[base:i])
                if m and not {w.lower() for w in m.group(2).split()} & NOT_NAMES:
                    words = [w.lower() for w in m.group(2).split()]
                    right = STREET_RIGHT.match(s, j)
                    pin = "pin" in s[j : right.end()].lower()
                    if pin or not any(x.isdigit() for w in words for x in w) and s[j : j + 1] in ("", ",", ".", " "):
                        found.append((base + m.start(), right.end() if pin else j, "street_address"))
    if not found:
        return []
    rank = {"email": 0, "id_number": 1, "street_address": 2, "phone": 3, "person_name": 4}
    found.sort(key=lambda x: (x[0], rank[x[2]], -x[1]))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if out and x[0] < out[-1][1]:
            if rank[x[2]] < rank[out[-1][2]] and x[0] == out[-1][0]:
                out[-1] = x
            continue
        out.append(x)
    return out


def _composed(chars: list[str], starts: list[int], ends: list[int]) -> tuple[list[str], list[int], list[int]]:
    """`lookalike.composed` of characters with their spans: a letter and its marks share one."""
    if unicodedata.is_normalized("NFC", "".join(chars)):
        return chars, starts, ends
    c2, s2, e2, i = [], [], [], 0
    while i < len(chars):
        j = i + 1
        while j < len(chars) and unicodedata.combining(chars[j]):
            j += 1
        for ch in unicodedata.normalize("NFC", "".join(chars[i:j])):
            c2.append(ch)
            s2.append(starts[i])
            e2.append(ends[j - 1])
        i = j
    return c2, s2, e2


def aligned(f: Rewriter, t: str) -> tuple[str, list[int], list[int]]:
    """The consistent form of `t` with the span in `t` behind each character."""
    chars, starts, ends = _composed(list(t), list(range(len(t))), list(range(1, len(t) + 1)))
    for _ in range(2):
        text, c2, s2, e2, pos = "".join(chars), [], [], [], 0
        for end, (n, rep) in f.auto.iter_long(text):
            i = end - n + 1
            c2 += chars[pos:i]
            s2 += starts[pos:i]
            e2 += ends[pos:i]
            for ch in rep:
                c2.append(ch)
                s2.append(starts[i])
                e2.append(ends[end])
            pos = end + 1
        chars, starts, ends = _composed(c2 + chars[pos:], s2 + starts[pos:], e2 + ends[pos:])
    out, s3, e3 = [], [], []
    for ch, a, b in zip(chars, starts, ends):
        if ch.isspace():
            if not out or out[-1] == " ":
                continue
            ch = " "
        out.append(ch)
        s3.append(a)
        e3.append(b)
    while out and out[-1] == " ":
        out.pop()
    return "".join(out), s3, e3


def redact(t: str, f: Rewriter) -> tuple[str, list[str]]:
    """The text with placeholders, and the types found, sorted."""
    s = f(t)
    spans = details(s)
    if not spans:
        return t, []
    u, starts, ends = aligned(f, t)
    if u != s:  # two rounds of rewriting went further than the form: look again there
        spans = details(u)
    out, pos = [], 0
    for i, j, kind in spans:
        a, b = starts[i], ends[j - 1]
        out += [t[pos:a], PLACEHOLDER[kind]]
        pos = b
    out.append(t[pos:])
    return "".join(out), sorted({k for _, _, k in spans})


def redacted(df: DataFrame, text: str = "raw_text", table: dict[str, str] | None = None) -> DataFrame:
    """Add `redacted_text` and `pii_types` (sorted, empty where none is found)."""
    table = lookalike_table(df, text) if table is None else table

    @F.pandas_udf("redacted_text string, pii_types array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        f = rewriter(table)
        rows = [(None, []) if t is None else redact(t, f) for t in s]
        return pd.DataFrame(rows, columns=["redacted_text", "pii_types"])

    d = df.withColumn("__tw_pii", run(F.col(text)))
    return d.withColumn("redacted_text", F.col("__tw_pii.redacted_text")).withColumn("pii_types", F.col("__tw_pii.pii_types")).drop("__tw_pii")
