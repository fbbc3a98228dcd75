"""Look-alikes, personal details, languages and spam on small fixtures."""

import pytest

pytest.importorskip("tidewright.llm")

from tidewright.llm import language, lookalike, personal, spam  # noqa: E402

ALIKE = [
    ("nаvimbаkаdu", "navimbakadu"),  # Cyrillic
    ("Αdаngаtһаrа", "Adangathara"),  # Greek and Cyrillic
    ("ｍｅｄｉｃｉｎｅ １２", "medicine 12"),
    ("peo\xadple w​ith﻿ us", "people with us"),
    ("a　 b c\xa0", "a b c"),
    ("café", "café"),
    ("kādu", "kādu"),
    ("kа̄du", "kādu"),  # Cyrillic letter with a mark
    ("n͏a‍̄du", "nādu"),
    ("Case‑0001", "Case-0001"),
    ("ﬁnish", "finish"),
    ("b\u1ea5t", "b\u00e2\u0301t"),
    ("b\u1ea5t", "b\u0430\u0302\u0301t"),  # a Cyrillic letter with two marks
    ("q\u0323\u0307", "q\u0307\u0323"),
    ("\uff76\uff9e", "\u30ac"),  # half-width letter and voiced mark
    ("\u2163", "IV"),
    ("\u13a0\u13a2", "DT"),
    ("\u04c0", "I"),
    ("मरीज़", "मरीज़"),
    ("ന്‍", "ൻ"),
]
DIFFERENT = [("Boat", "boat"), ("café", "cafe"), ("0", "O"), ("1", "l"), ("ക്‌ഷ", "കഷ"), ("a b", "ab")]


@pytest.fixture(scope="module")
def rewrite():
    texts = [x for p in (*ALIKE, *DIFFERENT) for x in p] + ["plain text of letters"] * 9
    counts: dict[str, int] = {}
    for t in texts:
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    return lookalike.Rewriter(lookalike.rewrites(counts))


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(rewrite, a, b):
    assert rewrite(a) == rewrite(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(rewrite, a, b):
    assert rewrite(a) != rewrite(b)


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_rewriting_settles(rewrite, a, b):
    assert rewrite(rewrite(a)) == rewrite(a)


def test_representatives_do_not_depend_on_size():
    for k in (1, 1000):
        assert lookalike.rewrites({"а": 40 * k, "a": 60 * k, "о": 300 * k, "o": 1 * k})["а"] == "a"
        assert lookalike.rewrites({"а": 40 * k, "a": 60 * k, "о": 300 * k, "o": 1 * k})["o"] == "о"


def test_spans_of_composed_texts():
    f = lookalike.Rewriter(lookalike.rewrites({c: 1 for c in "cal 012345678q\u0323\u0307\u0430\u0302\u0301+"}))
    t = "q\u0307\u0323 \u0430\u0302\u0301 call 5997680846 \u0430\u0301"
    u, starts, ends = personal.aligned(f, t)
    assert u == f(t) and len(u) == len(starts) == len(ends)
    assert personal.redact(t, f) == (t.replace("5997680846", "<PHONE>"), ["phone"])


def test_alike_classes(spark):
    rows = [("m1", "hello w\u043erld"), ("m2", "hello  world"), ("m2", "hello  world"), ("m3", "else"), ("m4", None), ("m5", " ")]
    got = {r.message_id: r for r in lookalike.alike_classes(spark.createDataFrame(rows, "message_id string, raw_text string")).collect()}
    assert set(got) == {"m1", "m2", "m3"} and got["m1"].class_id == got["m2"].class_id != got["m3"].class_id
    assert got["m1"].spelling_id != got["m2"].spelling_id


def test_alike_pairs(spark):
    rows = [("m1", "hello wоrld"), ("m2", "hello  world"), ("m3", "hello world "), ("m3", "hello world "), ("m4", "hello world "), ("m5", None), ("m6", "​"), ("m7", " "), ("m8", "else")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "message_id string, raw_text string, form int, raw string")
    got = {(r.a, r.b) for r in lookalike.alike_pairs(df).collect()}
    assert got == {("m1", "m2"), ("m1", "m3"), ("m1", "m4"), ("m2", "m3"), ("m2", "m4")}


def test_canonical_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "ｘ", "k"), (3, "x" * 200_000, "k")], "id int, raw_text string, canonical_text string")
    got = {r.id: r.canonical_text for r in lookalike.canonical(df).collect()}
    assert got == {1: None, 2: "x", 3: "x" * 200_000}
    assert lookalike.canonical(df.limit(0)).count() == 0


CASES = [
    ("my number is +91 52557 76232, come", {"phone"}),
    ("ring (0400) 2389 763 or knock", {"phone"}),
    ("call 5997680846 when close. ref 000033729", {"phone"}),
    ("ring five two nine one eight zero three eight seven zero or knock", {"phone"}),
    ("write to manoj.k (at) post.example for the list", {"email"}),
    ("list a.b[at]inbox[dot]invalid par bhej dena", {"email"}),
    ("reply at mundo_a at post dot example please", {"email"}),
    ("mera aadhaar 0711 1597 3712 hai", {"id_number"}),
    ("voter id QXW 0051735 likh lena", {"id_number"}),
    ("ration card RC-0801/624803 is with me", {"id_number"}),
    ("passport Q0926873 got wet", {"id_number"}),
    ("the address is door no. 213-5, tamarind street, 2nd floor", {"street_address"}),
    ("come to 224 Old Ferry Road, pin 017399 please", {"street_address"}),
    ("my name is Radha K. Testhouse, come", {"person_name"}),
    ("contact Dr. Vinod Someplace on arrival", {"person_name"}),
    ("मेरा नाम देवन ओट्टाकोविल है", {"person_name"}),
    ("മീര പല്ലത്തുവേലിൽ എവിടെയെന്ന് അറിയില്ല", {"person_name"}),
    ("Lost contact with 11 relatives", set()),
    ("meet @ 5pm near Leela Memorial Hall", set()),
    ("helpline 1077, batch 2026-0817-44, 9.6383, 76.5847", set()),
    ("Four houses on the bund road are going under with 7 people", set()),
    ("need dry rations, form no 000061015", set()),
]

# Texts that no table holds.
CASES += [
    ("my name is Xu Li", {"person_name"}),
    ("this is Ravi Kumar, call me back, I am speaking from the roof", set()),
    ("this is Ravi Kumar speaking, we are safe", {"person_name"}),
    ("send it to mailto:lost.found@desk.example today", {"email"}),
    ("tel:+44 2079460958 rings in the evening", {"phone"}),
    ("the number on the card reads 234123412346 in blue", {"id_number"}),  # its check digit is right
    ("the parcel code reads 234123412345 in blue", set()),
    ("aadhaar, as far as I remember from the photo that my cousin sent me last winter 2341 2341 2346", {"id_number"}),
    ("my voter card got wet. The crate is marked ABC1234567", set()),
    ("a" * 90 + "@post.example is too long for no window", {"email"}),
    ("nine one one", set()),
    ("stock 12 of 400, 18-20 crates, 3.5 m", set()),
]


def test_check_digits():
    assert personal.verhoeff("2363") and not personal.verhoeff("2364")
    for d in "0123456789":
        whole = [x for x in "0123456789" if personal.verhoeff("7154" + d + x)]
        assert len(whole) == 1  # one check digit for each number


def test_very_long_texts():
    t = "call 5997680846 or " + "people are waiting here " * 20_000 + "my name is Xu Li"
    assert {k for _, _, k in personal.details(t)} == {"phone", "person_name"}
    assert personal.details("7" * 100_000) == [] and personal.details("@" * 20_000) == []


@pytest.mark.parametrize(("t", "want"), CASES)
def test_details(t, want):
    assert {k for _, _, k in personal.details(t)} == want


def test_redaction_keeps_the_rest(spark):
    t = "Наме: ring　＋91​ 52557 76232　or knock, ｂｏａｔ"
    df = spark.createDataFrame([("a", t, 1), ("b", None, 2), ("c", "", 3)], "message_id string, raw_text string, redacted_text int")
    got = {r.message_id: (r.redacted_text, list(r.pii_types)) for r in personal.redacted(df).collect()}
    assert got["a"] == ("Наме: ring　<PHONE>　or knock, ｂｏａｔ", ["phone"])
    assert got["b"] == (None, [])
    assert got["c"] == ("", [])


EN = ["the river is rising near the old mill", "please send a boat for the children", "we need water and food today", "nobody has come to help us yet", "there are ten people on the roof"]
HI = ["paani bahut badh gaya hai ghar me", "hum log chhat par baithe hain", "kripya naav bhejo jaldi se", "bachche ke saath koi nahi hai", "हमें पानी और खाना चाहिए अभी"]
ML = ["ഞങ്ങൾ മുകളിൽ കുടുങ്ങി വേഗം വരണം", "ദയവായി ബോട്ട് അയക്കണം ഇപ്പോൾ തന്നെ", "വീട്ടിൽ വെള്ളം കയറി സഹായം വേണം"]


@pytest.fixture(scope="module")
def net():
    rows = [(t, "en") for t in EN] + [(t, "hi") for t in HI] + [(t, "ml") for t in ML]
    rows = rows * 30 + [(EN[0], "hi"), (HI[0], "en")] * 3  # some labels are wrong
    return language.train([t for t, _ in rows], [x for _, x in rows], {}, ["Velottakulam", "Orekavayal Hospital", "Munimbacheri"])


@pytest.mark.parametrize(("t", "want"), [*((t, {"en"}) for t in EN), *((t, {"hi"}) for t in HI), *((t, {"ml"}) for t in ML), (f"{EN[1]}. {HI[2]}.", {"en", "hi"})])
def test_language(net, t, want):
    assert {s[1] for s in language.judge([t], net, {})[0] if s[1]} == want


def test_language_edges(net):
    assert language.judge([None, "", "12:30 77", "🙏"], net, {}) == [[], [], [], []]


def test_mislabelled(spark):
    rows = [(f"e{i}", t, "en") for i in range(12) for t in EN] + [(f"h{i}", t, "HI") for i in range(12) for t in HI] + [(f"l{i}", t, "ml-IN") for i in range(12) for t in ML]
    rows = [(f"{a}{k}", t, x) for k, (a, t, x) in enumerate(rows)]
    extra = [("x1", EN[0], None), ("x2", HI[1], "??"), ("x3", ML[0], "en"), ("x4", f"{EN[1]}. {HI[2]}.", "en"), ("x5", f"{EN[1]}. {HI[2]}.", "Mixed "), ("x6", "123", None), ("x7", None, None)]
    df = spark.createDataFrame([(*r, "z") for r in rows + extra], "message_id string, raw_text string, detected_language string, langs string")
    got = {(r.message_id, r.lang) for r in language.mislabelled(df).collect()}
    assert got == {("x1", "en"), ("x2", "hi"), ("x3", "ml"), ("x4", "en"), ("x4", "hi")}
    assert language.mislabelled(df.limit(0)).count() == 0


SPAM = [
    "Call for pump rental, book pump rental, get pump rental now. Why pump rental? Because pump rental means pump rental.",
    "#blankets #solarlamp #blankets #pumprental #solarlamp #blankets #boats",
    "[map](http://a.example/x) [form](www.b.invalid/y?id=3) [lamp store](https://c.example/z)",
    "solar lamp | pump rental | solar lamp | pump rental | solar lamp | solar lamp | pump rental",
    "pump rental\nsolar lamp\npump rental\npump rental\nsolar lamp\nsolar lamp\npump rental",
    "solar lamp near Oak Bridge\nsolar lamp in Elm Street\nsolar lamp Pine Hall\nsolar lamp near Ash Mill\nsolar lamp in Fir Lane\nsolar lamp near Yew Dock\nNo losses were recorded in ward 2.",
    "Looking for blankets? Our blankets is the blankets you want. Call for blankets, book blankets, get blankets now. Best blankets for blankets buyers, blankets today.",
    "Tags: rescue boat, blankets, sale, size L, blue, new, cheap generator",
]
REAL = [
    "Stock at the library, 16:23\nparacetamol: 399 boxes, 11 issued\nmilk powder: 337 boxes, 68 issued\nparacetamol: 12 boxes, 3 issued",
    "Hourly log\n00:00 gauge 168 cm, no change\n01:00 gauge 134 cm, no change\n02:00 gauge 80 cm, no change",
    "The road was blocked near the mill. Volunteers repaired two boats. See http://help.example/map",
    "Crew roster\nboat-013 ward 35 from 12.49 am; boat-009 ward 21 from 14:55; boat-059 ward 32 from 12:45; boat-003 ward 38 from 10am; boat-029 ward 26 from 02:49; boat-021 ward 35 from 2pm",
    "Road status\nOak Bridge to Elm Hall: boats only, 3 feet water\nPine Mill to Ash Dock: closed, 9 feet water\nFir Lane to Yew Street: open",
    "",
    "\n",
]


NOUNS = "blankets lamp pump boat rope generator insurance tarpaulin loan camp food water kit medicine raft tent torch filter stove jacket".split()
VERBS = "carried moved checked repaired counted reported found reached closed opened".split()
WHERE = "mill bridge school library temple junction harbour market depot church".split()


STUFFED, ORDINARY = ("links", "tags", "bars", "lines", "calls"), ("prose", "log", "stock", "linked", "brief")


def pages(kind: str, n: int, seed: int) -> list[str]:
    """Made-up pages of one kind, by numbers drawn from a seed."""
    import random

    r = random.Random(f"{kind}{seed}")
    noun = lambda: f"{r.choice(NOUNS)} {r.choice(NOUNS)}"
    url = lambda: f"{r.choice(['http://', 'www.'])}{r.choice('abcd')}.example/{r.choice(NOUNS)}/{r.randint(1, 99)}"
    said = lambda: f"The crew {r.choice(VERBS)} {r.randint(2, 90)} {r.choice(NOUNS)} near the {r.choice(WHERE)} before the {r.choice(['tide', 'rain', 'shift'])}."
    out = []
    for _ in range(n):
        k = r.randint(6, 30)
        own = [noun() for _ in range(r.randint(1, 6))]
        bar = r.choice([" | ", " / ", " · "])
        lead = said() + "\n" if kind in STUFFED and r.random() < 0.3 else ""
        out.append(lead + {
            "links": lambda: "\n".join(f"[{noun()}]({url()})" if r.random() < 0.5 else url() for _ in range(k)),
            "tags": lambda: " ".join("#" + noun().replace(" ", "") for _ in range(k)),
            "bars": lambda: bar.join(r.choice(own) for _ in range(k)),
            "lines": lambda: "\n".join(r.choice(own) for _ in range(k)),
            "calls": lambda: " ".join(r.choice([f"Call for {own[0]}, book {own[0]}, get {own[0]} now.", f"Why {own[0]}? Because {own[0]} means {own[0]}."]) for _ in range(k)),
            "prose": lambda: " ".join(said() for _ in range(k)),
            "log": lambda: "Hourly log\n" + "\n".join(f"{h:02d}:00 gauge {r.randint(50, 300)} cm, no change" for h in range(min(k, 24))),
            "stock": lambda: f"Stock at the {r.choice(WHERE)}, 16:23\n" + "\n".join(f"{r.choice(NOUNS)}: {r.randint(1, 400)} boxes, {r.randint(1, 80)} issued" for _ in range(k)),
            "linked": lambda: " ".join(said() for _ in range(k)) + f" See {url()}",
            "brief": lambda: r.choice([said(), "Home | Camps | Contact\n" + said(), "n/a"]),
        }[kind]())
    return out


@pytest.fixture(scope="module")
def trees():
    import numpy as np

    own = list(spam.lessons([t for k in STUFFED for t in pages(k, 25, 1)] + [t for k in ORDINARY for t in pages(k, 60, 1)]))
    return spam.trained(np.concatenate([x for x, _ in own]).astype(float), np.concatenate([y for _, y in own]))


@pytest.mark.parametrize("kind", STUFFED + ORDINARY)
def test_held_out_pages(trees, kind):
    s = spam.page_scores(pages(kind, 40, 2), trees) > 0.5
    assert (s if kind in STUFFED else ~s).mean() >= 0.9


def test_the_stuffed_part_is_measured(trees):
    prose, tags = pages("prose", 1, 3)[0], pages("tags", 1, 3)[0]
    few, many = spam.page_scores([prose * 3 + "\n" + tags, prose[:60] + ".\n" + tags * 3], trees)
    assert few < 0.5 < many


def test_page_edges(trees):
    assert spam.page_scores([None, "", "\n", "!", " \u200b"], trees).tolist() == [0.0] * 5
    long_ = " ".join(pages("prose", 300, 4))
    assert spam.page_scores([long_, "\n".join(pages("links", 300, 4))], trees).round(1).tolist() == [0.0, 1.0]
    assert spam.page_scores(["<a " * 50_000, "[" * 100_000, "www." * 50_000], trees).shape == (3,)


def test_without_labels_nothing_is_spam():
    import numpy as np

    none = spam.trained(np.zeros((0, len(spam.FEATURES))), np.zeros(0))
    assert spam.page_scores(pages("tags", 3, 1), none).tolist() == [0.0] * 3


def test_spam_pages(spark):
    bad = [t for k in STUFFED for t in pages(k, 14, 5)]
    good = [t for k in ORDINARY for t in pages(k, 40, 5)]
    rows = [(i, t, f"http://bad.example/{i}") for i, t in enumerate(bad)] + [(1000 + i, t, f"www.good.example/{i}") for i, t in enumerate(good)] + [(9000, None, None), (9001, bad[0], None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, page_url string, score double")
    out = spam.scored(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    found = {k for k, r in got.items() if r.spam}
    want = set(range(len(bad))) | {9001}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    assert got[0].page_score == got[9001].page_score and got[9001].host_rate is None and got[9000].page_score == 0
    # The host decides where the page does not.
    assert got[0].host_rate > 0.5 > got[1000].host_rate
    assert spam.scored(df.limit(0)).count() == 0


def test_the_host_decides_a_page_in_doubt(spark):
    """Two pages of one score, one on a host of spam, one on a clean one."""
    doubt = {"doubt": 0.49, "good": 0.0, "bad": 1.0}
    df = spark.createDataFrame([(i, "bad", "x.example") for i in range(40)] + [(100 + i, "good", "y.example") for i in range(40)] + [(200, "doubt", "x.example"), (201, "doubt", "y.example")], "doc_id long, text string, page_url string")
    pages_ = df.select("doc_id", spam.F.col("text").alias("t"), "page_url")
    scores = spark.createDataFrame(list(doubt.items()), "t string, page_score double")
    p = pages_.join(scores, "t").select(spam.F.col("doc_id").alias("id"), spam.host(spam.F.col("page_url")).alias("host"), "page_score")
    got = {r.id: r.spam for r in spam.smoothed(p).collect()}
    assert got[200] and not got[201]
