"""Text normalisation and marker-based language as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark romanised Hindi and English.
HINDI_MARKERS = (
    "hai hain ho gaya gayi gaye raha rahi rahe kar karo kare kijiye bhejiye bhejo ke ki ka ko se me mein par paas peeche saamne nazdeek "
    "aur nahi nahin log logo hum ham humein hamari hamare aap tum mera meri mere uska unka chahiye zarurat jarurat madad kripya please1 "
    "turant abhi jaldi bahut yaha wahan idhar udhar kal aaj subah shaam raat din pani paani khana rashan ghar makan gaadi sadak rasta pul "
    "palam fase fasa phase bhar bhara gir gira tut tuta kat kata khatam bimar ghayal behosh mar mara zinda bacha bache budhe ek do teen "
    "char paanch chhe saat aath nau das"
).split()
ENGLISH_MARKERS = (
    "the a an is are was were be been being have has had do does did of to in on at for with from by about into over after we us our you "
    "your they them their he she it its and but or if because while when where which who what need needs needed please help urgent please "
    "send required people person family families house home road water food medical stuck trapped stranded rising submerged cannot cant"
).split()
# Shorthand and what it stands for.
EXPANSIONS = {
    "pls": "please", "plz": "please", "plss": "please", "urgnt": "urgent", "ppl": "people", "peeps": "people", "immdtly": "immediately",
    "immdt": "immediate", "watr": "water", "wtr": "water", "nd": "need", "hlp": "help", "b4": "before", "msg": "message", "hosp": "hospital",
    "med": "medicine", "meds": "medicine", "kids": "children", "tmrw": "tomorrow", "u": "you", "r": "are", "n": "and", "ur": "your",
    "asap": "urgently", "sos": "sos", "govt": "government", "amb": "ambulance", "kms": "kilometres", "hrs": "hours", "mins": "minutes",
    "info": "information", "loc": "location", "lat": "latitude",
}
TOKEN = r"([a-z0-9]+|[^\sa-z0-9])"


def let(c: Column, f) -> Column:  # noqa: ANN001
    """f(c), with `c` evaluated once however often `f` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def words(c: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def language(c: Column) -> Column:
    """Struct (language, confidence, hi_hits, en_hits) by marker words: no words
    (en, .2), no markers (en, .25), else by the share of Hindi among the markers,
    damped where there are few of them."""
    hits = lambda w: F.struct(
        F.size(w).alias("w"), F.size(F.filter(w, lambda x: x.isin(*HINDI_MARKERS))).alias("hi"), F.size(F.filter(w, lambda x: x.isin(*ENGLISH_MARKERS))).alias("en")
    )
    return let(let(words(c), hits), _language)


def _language(h: Column) -> Column:
    hi, en = h["hi"], h["en"]
    n = hi + en
    share = hi / n
    lang = F.when(n == 0, "en").when(share >= 0.72, "hi").when(share <= 0.18, "en").otherwise("mixed")
    base = F.when(share >= 0.72, share).when(share <= 0.18, 1 - share).otherwise(1 - F.abs(share - 0.45) * 1.6)
    damped = F.bround(clip(base * (0.55 + 0.45 * F.least(F.lit(1.0), n / 5)), 0.2, 0.98), 3)
    conf = F.when(h["w"] == 0, F.lit(0.2)).when(n == 0, F.lit(0.25)).otherwise(damped)
    return F.struct(lang.alias("language"), conf.alias("confidence"), hi.alias("hi_hits"), en.alias("en_hits"))


def tokens(c: Column) -> Column:
    """Alphanumeric runs, and every other visible character by itself."""
    return F.regexp_extract_all(F.lower(F.trim(c)), F.lit(TOKEN), F.lit(1))


def expanded(tok: Column) -> Column:
    """Tokens with shorthand written out."""
    m = F.create_map(*[F.lit(x) for kv in EXPANSIONS.items() for x in kv])
    return F.transform(tok, lambda t: F.coalesce(m[t], t))


def detokenized(tok: Column) -> Column:
    """Tokens joined, without blanks before closing and after opening marks."""
    s = F.regexp_replace(F.array_join(tok, " "), r" ([,.!?;:%)'])", "$1")
    return F.regexp_replace(s, r"\( ", "(")


def clean_id(c: Column) -> Column:
    """An id without case and surrounding blanks."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def place_norm(c: Column) -> Column:
    """Lower-cased, with one blank for each run of other than a-z and 0-9."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " "))


def deletions(c: Column) -> Column:
    """A word and all words that lack one of its letters."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), F.when(n > 3, cut).otherwise(F.array().cast("array<string>"))))


def edit_cost(a: Column, b: Column) -> Column:
    """0 for equal words, 1 for one substitution, insertion, deletion or swap of
    neighbours, else 2."""
    n = F.length(a)
    at = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    swapped = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + 1, F.lit(1)), F.substring(a, at, F.lit(1)), F.substring(a, at + 2, n))
    swap = (F.length(b) == n) & at.isNotNull() & (swapped == b)
    return F.when(a == b, 0).when((F.levenshtein(a, b) <= 1) | F.coalesce(swap, F.lit(False)), 1).otherwise(2)


def corrections(tok: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, correction) of distinct tokens against (word, rank).

    Tokens shorter than 4, numbers and known words stay.  Candidates share a
    deletion with the token; the least (cost, rank, -length, word) wins.  Words
    and tokens meet by equality on deletions, never all with all.
    """
    t = tok.select("token").distinct()
    v = vocabulary.select("word", "rank").distinct()
    open_ = t.filter((F.length("token") >= 4) & ~F.col("token").rlike("^[0-9]+$")).join(v, F.col("token") == F.col("word"), "left_anti")
    keys = open_.select("token", F.explode(deletions(F.col("token"))).alias("k"))
    index = v.select("word", "rank", F.explode(deletions(F.col("word"))).alias("k"))
    pairs = keys.join(index, "k").select("token", "word", "rank").distinct()
    order = F.struct(edit_cost(F.col("token"), F.col("word")), F.col("rank"), -F.length("word"), F.col("word"))
    best = pairs.groupBy("token").agg(F.min_by("word", order).alias("correction"))
    return t.join(best, "token", "left").select("token", F.coalesce("correction", "token").alias("correction"))
