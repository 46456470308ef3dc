"""Sentence boundaries across languages and scripts.

Two passes over whole texts. The first counts, per language, how words stand with and without a
period and what follows them; log-likelihood ratios turn the counts into abbreviations,
collocations, sentence starters and sentence enders, without any labels. The second restores the reading order of
each page and classifies every mark by these statistics.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.layout import ADVERT, BODY, Line, read_page
from tickloom.session import Scratch

# Codes of languages with several spellings.
CODES = {
    "eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "rus": "ru", "gre": "el", "ell": "el",
    "ara": "ar", "urd": "ur", "hin": "hi", "chi": "zh", "zho": "zh", "jpn": "ja", "tha": "th", "und": "", "unk": "", "mul": "",
}

# Marks that close a sentence, quotation marks, and marks of words broken at line ends.
TERMINALS = ".!?…。！？．।॥|۔؟·"
OPENERS, CLOSERS, EITHER = "„«“‘»「『", "”»“’«‘」』", "\"'"
BROKEN = "-¬‐­"
#: Longest quotation or bracket, in characters, that is taken as one: in longer ones a mark is missing.
LONGEST_QUOTE, LONGEST_BRACKET = 900, 160
#: Lengths of the strings before blanks among which sentence enders of Thai are sought.
ENDER_LENGTHS = (3, 4)
#: Least score of an abbreviation (Kiss and Strunk 2006).
ABBREVIATION_SCORE = 0.3
#: Below this share of capitals after commas, a capital there shows a misread period.
CAPITALS_AFTER_COMMAS = 0.08
#: Least log-likelihood ratio of a collocation (chi-squared, p < 0.005).
COLLOCATION = 7.88
#: Least log-likelihood ratio of a sentence starter (Kiss and Strunk 2006).
STARTER = 30
#: Words that must be more frequent in a Latin group than in each larger one, that it counts as a language.
OWN_WORDS = 15
#: A labelled group without common words of its own is left for another if the text has that one's
#: common words at least this often, as a multiple of their share there.
FOREIGN_SHARE = 0.5
#: Characters before a mark in which its word is sought. The score of an abbreviation shrinks with
#: exp(-letters), so none of this length is ever learned, and longer words need not be seen whole.
LOOK_BACK = 64
#: Stands for any number before a period in the counts of pairs.
NUMBER = "#"

_SCRIPTS = (
    ("thai", re.compile("[฀-๿]+")), ("deva", re.compile("[ऀ-ॿ]+")), ("arab", re.compile("[؀-ۿ]+")),
    ("kana", re.compile("[぀-ヿ]+")), ("hani", re.compile("[一-鿿]+")), ("cyrl", re.compile("[Ѐ-ӿ]+")),
    ("grek", re.compile("[Ͱ-Ͽἀ-῿]+")), ("latn", re.compile("[A-Za-zÀ-ɏ]+")),
)
_URDU = re.compile("[ٹڈڑےںہگپچ]")
#: Scripts with capitals.
CASED = frozenset(("latn", "cyrl", "grek"))
#: Scripts whose words are not set apart by blanks.
SOLID = frozenset(("hani", "kana", "thai"))

_WORD = re.compile(r"(?:[^\W\d_]{1,3}\.)+[^\W\d_]{1,3}\.?(?![^\W\d_])|[^\W\d_]+\.?")
_UNIT = re.compile(r"[^\s.,!?;:()\"'“”«»‘’।۔،؟|॥\d…]+(?:\.[^\s.,!?;:()\"'“”«»‘’।۔،؟|॥\d…]{1,2})*\.?")
_FOLLOW = re.compile(r"([.!?]) +([\"'“”«»„‘’]?) ?(\S)")
_SURE = re.compile(r"[!?؟۔।॥] +(?=[^\s\d])")
_REPORT = re.compile(r"[!?,،。！？][\"'”»’」』]\s*([^\s.,!?،۔।。！？]{1,12})")
_JOINT = re.compile(rf"[{BROKEN}] *\n")
_COMMA = re.compile(r"[^\W\d_]{2} ?, ([^\W\d_])")
# in scripts without blanks both take the same two characters (one before a mark), so that they compare
_SOLID_REPORT = re.compile(r"[!?,。！？][\"'”»’」』]\s*([^\s「」『』“”\"'.,!?。！？，、…]{1,2})")
_PLAIN = re.compile(r"[。！？]\s*([^\s「」『』“”\"'.,!?。！？，、…]{1,2})")
_THAI_BLANK = re.compile(r"([฀-๿]{4,6}) +(?=[฀-๿])")


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    return next((name for name, pattern in _SCRIPTS if pattern.match(ch)), "")


def script_of(text: str) -> str:
    """The script that most of the letters of a text are in ('' without letters); texts with some
    kana among their ideographs are Japanese."""
    present = {_script(ch) for ch in set(text)} - {""}
    if len(present) < 2:
        return present.pop() if present else ""
    counts: Counter = Counter()
    for ch, n in Counter(text).items():
        counts[_script(ch)] += n
    if counts["kana"] * 12 > len(text):
        return "kana"
    return max((name for name, _ in _SCRIPTS), key=lambda name: counts[name])


def group_of(text: str, lang: str | None) -> tuple[str, str]:
    """(script, group): texts of a group share statistics. In the Latin script the group is the
    labelled language ('' without a label), else the script, with Urdu apart from Arabic."""
    script = script_of(text)
    if script == "latn":
        code = (lang or "").strip().lower().replace("_", "-").split("-")[0]
        return script, "latn-" + CODES.get(code, code)
    if script == "arab":
        return script, "arab-ur" if len(_URDU.findall(text)) * 25 > len(text) else "arab"
    return script, script


def _kind(ch: str, quote: str) -> str:
    if quote:
        return "q"
    if ch.isdigit() or ch in "$§#.":
        return "D"
    return "U" if ch.isupper() else "l"


def count_text(text: str, lang: str | None, counts: Counter, raw: dict[str, Counter]) -> None:
    """Add a text's counts, with keys (group, what, item); its words go to `raw` as they stand."""
    script, group = group_of(text, lang)
    if script == "":
        return
    joined = _JOINT.sub("", text)
    unit = _WORD if script in CASED else _UNIT
    if script in ("hani", "kana"):
        for m in _SOLID_REPORT.finditer(joined):
            counts[group, "r", m[1]] += 1
        for m in _PLAIN.finditer(joined):
            counts[group, "rb", m[1]] += 1
        return
    if script == "thai":
        for m in _THAI_BLANK.finditer(text):
            for n in ENDER_LENGTHS:
                counts[group, "ts", m[1][-n:]] += 1
        for s in text.split("\n"):
            s = s.rstrip()
            if s and "฀" <= s[-1] <= "๿":
                for n in ENDER_LENGTHS:
                    counts[group, "tl", s[-n:]] += 1
        return
    raw[group].update(joined.split())
    for m in _FOLLOW.finditer(joined):
        p, mark = m.start(), m[1]
        if mark == ".":
            before = joined[max(0, p - LOOK_BACK) : p + 1].split()[-1]
            found = unit.findall(before)
            word = None
            if found and found[-1][-1] == ".":
                word = found[-1][:-1]
                counts[group, "f" + _kind(m[3], m[2]), word] += 1
            elif before[-2:-1].isdigit():
                word = NUMBER
            follower = word and not m[2] and not m[3].islower() and unit.match(joined, m.start(3))
            if follower:
                counts[group, "c", f"{word} {follower[0].rstrip('.').lower()}"] += 1
        elif p and not joined[p - 1].isspace():
            counts[group, "b" + _kind(m[3], m[2]), ""] += 1
    for m in _SURE.finditer(joined):
        follower = unit.match(joined, m.end())
        if follower:
            counts[group, "s", follower[0].rstrip(".").lower()] += 1
    if script not in CASED:
        for m in _REPORT.finditer(joined):
            counts[group, "r", m[1]] += 1
    else:
        for ch, n in Counter(_COMMA.findall(joined)).items():
            counts[group, "kU" if ch.isupper() else "kl", ""] += n


def _count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    raw: dict[str, Counter] = defaultdict(Counter)

    def out():
        for group, seen in raw.items():
            unit = _WORD if group.split("-")[0] in CASED else _UNIT
            for token, n in seen.items():
                for w in unit.findall(token):
                    if w[-1] == ".":
                        counts[group, "p", w[:-1]] += n
                    else:
                        counts[group, "w", w] += n
        raw.clear()
        keys = list(counts)
        for i in range(0, len(keys), 50_000):
            some = keys[i : i + 50_000]
            columns = [pa.array([k[j] for k in some], pa.string()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in some], pa.int64())], ["grp", "what", "item", "n"])
        counts.clear()

    for batch in it:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            if text and not text.isspace():
                count_text(text, lang, counts, raw)
        if len(counts) + sum(map(len, raw.values())) > 500_000:
            yield from out()
    yield from out()


def _llr(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's log-likelihood ratio of two binomial samples, negative if the first rate is lower."""

    def ll(k, n, p):
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    if not n1 or not n2:
        return 0.0
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    v = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    return v if p1 >= p2 else -v


def statistics(documents: DataFrame) -> DataFrame:
    """(grp, what, item, n): counts over all texts, combined per task before the shuffle."""
    return (
        documents.select("text", "lang").mapInArrow(_count_batches, "grp string, what string, item string, n long")
        .groupBy("grp", "what", "item").agg(F.sum("n").alias("n"))
    )


def _abbreviation_rows(stats: DataFrame) -> DataFrame:
    """Per group the words seen mostly with a period that score as abbreviations (or are single
    capitals), with what follows them. The score is the log-likelihood ratio of "always with a
    period" against the group's rate, times the penalties for length and for other uses."""
    total = stats.filter("what in ('p', 'w')").groupBy("grp").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("what") == "p", F.col("n"))).alias("total_p"))
    rows = (
        stats.filter("what in ('p', 'w', 'fU', 'fD', 'fq', 'fl')").groupBy("grp", "item")
        .agg(*(F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("p", "w", "fU", "fD", "fq", "fl")))
        .filter("p >= 3 and p > w")
        .join(total, "grp")
    )
    k, other = F.col("p"), F.col("w")
    p0 = F.least(F.col("total_p") / F.col("total"), F.lit(0.999))
    ll = 2 * (k * F.log(F.lit(0.99) / p0) + other * F.log(F.lit(0.01) / (1 - p0)))
    bare = F.replace("item", F.lit("."), F.lit(""))
    letters, periods = F.length(bare), F.length("item") - F.length(bare) + 1
    score = ll * F.exp(-letters.cast("double")) * periods * F.pow(letters.cast("double"), -other.cast("double"))
    single = (F.length("item") == 1) & (F.upper("item") == F.col("item")) & (F.lower("item") != F.col("item"))
    return rows.withColumn("single", single).filter((letters > 0) & (F.col("single") | (score >= ABBREVIATION_SCORE)))


def _llr_column(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """`_llr` of columns."""

    def ll(k, n, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    p = (k1 + k2) / (n1 + n2)
    v = 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when((n1 <= 0) | (n2 <= 0), F.lit(0.0)).when(k1 / n1 >= k2 / n2, v).otherwise(-v)


def _followers(stats: DataFrame, candidates: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sentence starters (grp, follower) and collocations (grp, word, follower).

    Sure ends are closing marks other than periods, and periods after words that are no
    `candidates` for abbreviations, no single letters and no numbers. A starter follows sure ends
    more often than it stands elsewhere, in capitals or not; only those that also follow other
    periods are asked for. A small letter says by itself that a sentence goes on, so followers
    that begin with one are not counted and all are in small letters here. A collocation is
    a follower that stands after an abbreviation or number more often than after sure ends, so that
    the period between them belongs to the word; after an abbreviation only starters are in doubt.
    Pairs seen once are none.
    """
    pairs = stats.filter("what = 'c'").select("grp", F.substring_index("item", " ", 1).alias("word"), F.substring_index("item", " ", -1).alias("follower"), "n")
    pairs = pairs.join(candidates.select("grp", F.col("item").alias("word"), F.lit(True).alias("known")), ["grp", "word"], "left")
    unsure = F.coalesce("known", F.lit(False)) | (F.length("word") == 1)
    sure = pairs.filter(~unsure).select("grp", "follower", "n").unionByName(stats.filter("what = 's'").select("grp", F.col("item").alias("follower"), "n"))
    open_ = pairs.filter(unsure).select("grp", "word", "follower", "n")
    starts = sure.groupBy("grp", "follower").agg(F.sum("n").alias("k"))
    ends = starts.groupBy("grp").agg(F.sum("k").alias("ends"))
    words = stats.filter("what in ('p', 'w')").groupBy("grp", F.lower("item").alias("follower")).agg(F.sum("n").alias("all"))
    total = words.groupBy("grp").agg(F.sum("all").alias("total"))
    elsewhere, others = F.greatest(F.col("all") - F.col("k"), F.lit(0)), F.greatest(F.col("total") - F.col("ends"), F.lit(1))
    starters = (
        starts.join(open_.select("grp", "follower").distinct(), ["grp", "follower"], "left_semi")
        .join(words, ["grp", "follower"]).join(ends, "grp").join(total, "grp")
        .filter(_llr_column(F.col("k"), F.col("ends"), F.least(elsewhere, others), others) > STARTER).select("grp", "follower")
    )
    by_word = open_.groupBy("grp", "word").agg(F.sum("n").alias("whole"))
    starters = scratch.write(starters)
    doubtful = open_.filter("n >= 2").join(starters.withColumn("starts", F.lit(True)), ["grp", "follower"], "left").filter((F.col("word") == NUMBER) | (F.col("starts") & (F.length("word") > 1)))
    collocations = (
        doubtful.join(by_word, ["grp", "word"]).join(ends, "grp").join(starts, ["grp", "follower"], "left")
        .filter(_llr_column(F.col("n"), F.col("whole"), F.coalesce("k", F.lit(0)), F.col("ends")) > COLLOCATION).select("grp", "word", "follower")
    )
    return starters, collocations


def _solid_reporters(stats: DataFrame) -> DataFrame:
    """(grp, item): what follows quotations of Chinese and Japanese more often, by the ratio and
    ten times, than it opens a sentence."""
    counts = stats.filter("grp in ('hani', 'kana') and what in ('r', 'rb')").groupBy("grp", "item").agg(
        *(F.coalesce(F.sum(F.when(F.col("what") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("r", "rb")))
    whole = counts.groupBy("grp").agg(F.sum("r").alias("quoted"), F.sum("rb").alias("plain"))
    score = _llr_column(F.col("r"), F.col("quoted"), F.col("rb"), F.col("plain"))
    return counts.filter("r >= 5").join(whole, "grp").filter("r * plain > 10 * rb * quoted").filter(score > COLLOCATION).select("grp", "item")


def _common_rows(stats: DataFrame) -> DataFrame:
    """(grp, item, n, size): the most common words of the labelled Latin groups that are languages
    of their own, whatever their size: OWN_WORDS of them are more frequent there than in each
    larger group. Texts with a wrong label have the words of larger groups, none more often."""
    words = stats.filter("what = 'w' and grp like 'latn-_%'").select("grp", "item", "n")
    sizes = words.groupBy("grp").agg(F.sum("n").alias("size"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "item"))
    top = words.filter("length(item) > 1").withColumn("rank", rank).filter("rank <= 60").drop("rank").join(sizes, "grp")
    larger = sizes.select(F.col("grp").alias("other"), F.col("size").alias("other_size"))
    against = top.join(larger, (F.col("other_size") > F.col("size")) | (F.col("other_size") == F.col("size")) & (F.col("other") < F.col("grp")))
    there = words.select(F.col("grp").alias("other"), "item", F.col("n").alias("there"))
    score = _llr_column(F.col("n"), F.col("size"), F.coalesce("there", F.lit(0)), F.col("other_size"))
    shared = against.join(there, ["other", "item"], "left").filter(score <= COLLOCATION).select("grp", "item").distinct()
    largest = sizes.orderBy(F.desc("size"), "grp").limit(1).select("grp")
    own = top.join(shared, ["grp", "item"], "left_anti").groupBy("grp").count().filter(F.col("count") >= OWN_WORDS).select("grp")
    return top.join(own.union(largest).distinct(), "grp").select("grp", "item", "n", "size")


class Model:
    """What classification needs: small sets per group, filtered by their scores."""

    def __init__(self):
        self.abbreviations: dict[str, dict[str, str]] = defaultdict(dict)
        #: Words that open sentences, and (word, follower) whose period ends none.
        self.starters: dict[str, set] = defaultdict(set)
        self.collocations: dict[str, set] = defaultdict(set)
        self.reporters: dict[str, set] = defaultdict(set)
        self.enders: dict[str, set] = defaultdict(set)
        self.common: dict[str, set] = defaultdict(set)
        #: The share of a group's words that its common ones make up.
        self.share: dict[str, float] = {}
        #: Groups in whose sentences capitals hardly follow commas: one that does opens a sentence.
        self.plain_commas: set[str] = set()
        self._misread: dict[str, dict[str, str]] = {}

    def misread(self, group: str) -> dict[str, str]:
        """Abbreviations of four letters or more with one letter lost."""
        if group not in self._misread:
            known = {w: r for w, r in self.abbreviations.get(group, {}).items() if len(w) > 3 and "." not in w}
            self._misread[group] = {w[:i] + w[i + 1 :]: r for w, r in known.items() for i in range(len(w))}
        return self._misread[group]


#: Most words of a kind that a model may hold per group; learning stops with an error beyond it.
MODEL_BOUND = 200_000


def learn(documents: DataFrame) -> Model:
    """The model of a corpus; see `statistics`. Only words that pass their tests reach the driver,
    at most MODEL_BOUND of a kind (real languages have some hundred)."""
    scratch = Scratch(documents.sparkSession, "sentences")
    stats = scratch.write(statistics(documents))
    model = Model()
    base = {r["grp"]: r for r in stats.filter("what like 'b_'").groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("what").isin("bD", "bq"), F.col("n")).otherwise(0)).alias("k")).collect()}
    candidates = scratch.write(_abbreviation_rows(stats))
    for r in _bounded(candidates):
        single = r["single"]
        follows = r["fU"] + r["fD"] + r["fq"] + r["fl"]
        like_end = r["fD"] + r["fq"] + (r["fl"] if r["grp"].split("-")[0] in CASED else 0)
        share = like_end / follows if follows else 0
        if r["fD"] > 0.5 * follows:
            share = 0
        # numbers and quotations often open a sentence; a word inside sentences isn't followed by them
        b = base.get(r["grp"])
        ends = b["k"] / b["n"] if b and b["n"] else 0.1
        if share > 0.45 * max(ends, 0.1) and not single:
            continue  # its periods behave as those of any word at a sentence's end
        model.abbreviations[r["grp"]][r["item"]] = "M" if share > 0.02 and not single else "A"
    starters, collocations = _followers(stats, candidates, scratch)
    for r in _bounded(starters):
        model.starters[r["grp"]].add(r["follower"])
    for r in _bounded(collocations):
        model.collocations[r["grp"]].add((r["word"], r["follower"]))
    commas = stats.filter("what in ('kU', 'kl')").groupBy("grp").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("what") == "kU", F.col("n")).otherwise(0)).alias("k"))
    model.plain_commas = {r["grp"] for r in commas.collect() if r["k"] < CAPITALS_AFTER_COMMAS * r["n"]}
    reports = stats.filter("what = 'r' and grp not in ('hani', 'kana')").alias("a").join(
        stats.filter("what = 'w'").select("grp", "item", F.col("n").alias("w")).alias("b"), ["grp", "item"], "left"
    ).filter("a.n >= 5 and a.n > 0.3 * w").select("grp", "item", "n", "w")
    for r in _bounded(reports):
        if _llr(r["n"], r["w"] + 1, 1, 40) > COLLOCATION:
            model.reporters[r["grp"]].add(r["item"])
    for r in _bounded(_solid_reporters(stats)):
        model.reporters[r["grp"]].add(r["item"])
    ends = stats.filter("what in ('ts', 'tl')").groupBy("grp", "item").agg(
        F.coalesce(F.sum(F.when(F.col("what") == "ts", F.col("n"))), F.lit(0)).alias("s"), F.coalesce(F.sum(F.when(F.col("what") == "tl", F.col("n"))), F.lit(0)).alias("l")
    )
    sums = {r["grp"]: (r["s"], r["l"]) for r in ends.groupBy("grp").agg(F.sum("s").alias("s"), F.sum("l").alias("l")).collect()}
    least = min((s for s, _ in sums.values()), default=0) / 1000  # an ender stands before one blank in a thousand at least
    for r in _bounded(ends.filter("s >= 5 and s > l").filter(F.col("s") >= F.lit(least))):
        s, ln = sums[r["grp"]]
        if r["item"][-1] != "ๆ" and _llr(r["s"], r["s"] + r["l"], s - r["s"], s + ln - r["s"] - r["l"]) > COLLOCATION:
            model.enders[r["grp"]].add(r["item"])
    for r in _common_rows(stats).collect():
        model.common[r["grp"]].add(r["item"])
        model.share[r["grp"]] = model.share.get(r["grp"], 0) + r["n"] / r["size"]
    scratch.drop(stats, candidates, starters)
    return model


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MODEL_BOUND + 1).collect()
    if len(rows) > MODEL_BOUND:
        raise ValueError("too many candidates")
    return rows


_MARK = re.compile(r"[.!?…。！？．।॥|۔؟·;;　]+")
_CAPITAL = re.compile(r"(?<=\w)( ?,)[ \n]+(?=[^\W\d_a-zà-ÿа-яα-ω])([^\W\d_]+\.?)")
_TAIL = re.compile(r"(?:[ \u00a0]?[»”](?=[\s.,;!?…]|$)|[“«](?=[\s.,;!?…]|$)|[)\]\"”’'」』])*")
_ALNUM = re.compile(r"\w")
_NEXT = re.compile(r"\s*")
_PAIRS = re.compile(r"[\"'“”„«»‘’「」『』()（）]")
_NUMBER = re.compile(r"(?:§\s*)?[$#]?[\d.,]*\d$")
_SPLIT_WORD = re.compile(r"[\s\"“”«»„‘(\[—'’]")


def _quotes(s: str, solid: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Quotations and brackets of a text as (open, close) positions."""
    pairs, brackets, opened, bracket = [], [], None, None
    n = len(s)
    for m in _PAIRS.finditer(s):
        p, ch = m.start(), m[0]
        if ch in "(（":
            bracket = p
            continue
        if ch in ")）":
            if bracket is not None and p - bracket <= LONGEST_BRACKET:
                brackets.append((bracket, p))
            bracket = None
            continue
        if ch in "「『" or (solid and ch == "“"):
            role = "o"
        elif ch in "」』" or (solid and ch == "”"):
            role = "c"
        else:
            left = p == 0 or s[p - 1].isspace() or s[p - 1] in "([—-–"
            right = p + 1 >= n or s[p + 1].isspace() or s[p + 1] in ".,!?;:…)]—؟،۔।"
            if left and not right:
                role = "o"
            elif right and not left:
                role = "c"
            elif left and right:
                role = "o" if ch in "«„" else "c" if ch in "»”" else ("c" if opened else "o")
            elif ch in "'’" and s[p - 1].isalnum() and s[p + 1].isalnum():
                continue
            else:
                role = "c" if opened is not None else "o"
        if role == "o":
            opened = p
        elif opened is not None:
            if p - opened <= LONGEST_QUOTE:
                pairs.append((opened, p))
            opened = None
    return pairs, brackets


class Splitter:
    """Classifies the marks of one group's texts."""

    def __init__(self, model: Model, script: str, group: str):
        self.script, self.cased, self.solid = script, script in CASED, script in SOLID
        self.abbr = model.abbreviations.get(group, {})
        self.misread = model.misread(group)
        self.starters = model.starters.get(group, set())
        self.collocations = model.collocations.get(group, set())
        self.reporters = model.reporters.get(group, set())
        self.enders = model.enders.get(group, set())
        self.commas = self.cased and group in model.plain_commas

    def ends(self, s: str, breaks: list[tuple[int, bool]]) -> list[int]:
        """Positions after the last character of each sentence of a block.

        `breaks` are the line ends (position in `s`, whether the line is short though the next
        word would have fitted, so that a paragraph ends there).
        """
        pairs, brackets = _quotes(s, self.solid)
        closes = {b: a for a, b in pairs}
        bracket_closes = {b: a for a, b in brackets}
        # neither quotations nor brackets nest, so that of each only the last one begun can be open
        kinds = [(spans, [a for a, _ in spans]) for spans in (sorted(pairs), sorted(brackets))]

        def goes_on(at, behind):
            for spans, starts in kinds:
                k = bisect_right(starts, at)
                if k and spans[k - 1][1] >= behind:
                    return True
            return False

        found: list[int] = []
        begin, n = 0, len(s)
        thai = self.script == "thai"
        for m in _MARK.finditer(s):
            p, q = m.start(), m.end()
            if p < begin:
                continue
            mark = m[0]
            if mark == "　":
                if self.script == "hani" and s[begin:p].strip():
                    found.append(len(s[:p].rstrip()))
                    begin = q
                continue
            if mark[0] in ";;" and self.script != "grek" or mark == "|" and self.script != "deva":
                continue
            if mark in ".．" and q < n and s[q].isdigit() and (p == 0 or not s[p - 1].isalpha()):
                continue  # within or before a number
            after = _TAIL.match(s, q).end()
            # within a quotation or bracket that goes on behind the mark?
            if goes_on(p, after):
                continue
            tail = s[q:after]
            close = next((i for i in range(after - 1, q - 1, -1) if i in closes), None) if tail else None
            nxt = _NEXT.match(s, after).end()
            ch = s[nxt] if nxt < n else ""
            if ch and nxt == after and ch in ",،、，:;" or (ch and ch in ",،" and nxt == after):
                continue
            if close is not None:
                if not self._after_quote(s, mark, nxt, ch):
                    continue
            elif any(c in ")）]" for c in tail):
                a = next((bracket_closes[i] for i in range(q, after) if i in bracket_closes), None)
                whole = a is not None and not s[begin:a].strip()
                if not whole and not (self.cased and (ch == "" or ch.isupper() and nxt > after)):
                    continue
            elif not self._is_end(s, begin, p, q, after, mark, nxt, ch):
                continue
            found.append(after)
            begin = after
        if self.commas:
            found += self._misread_commas(s, goes_on)
        # quotations that end without a mark of their own never end a sentence; paragraphs do
        extra = []
        for at, paragraph in breaks:
            if paragraph or thai and any(s[max(0, at - k) : at] in self.enders for k in ENDER_LENGTHS):
                if not thai and goes_on(at - 1, at):
                    continue
                extra.append(at)
        if thai:
            for m in re.finditer(r"(?<![\d ])  *(?![\d ])", s):
                if m.start() and s[m.start() - 1] not in "ๆ,":
                    extra.append(m.start())
        merged, last = [], 0
        for e in sorted({*found, *extra, len(s.rstrip())}):
            piece = s[last:e]
            if _ALNUM.search(piece):
                merged.append(e)
                last = e
            elif merged and piece.strip() and not piece.strip().strip("".join((TERMINALS, CLOSERS, EITHER, ")]"))):
                merged[-1] = e
                last = e
        return merged

    def _misread_commas(self, s: str, goes_on) -> list[int]:
        """Commas after a common word and before a capital that begins no name: misread periods."""
        out = []
        for m in _CAPITAL.finditer(s):
            if m[2][-1] == "." or len(m[2]) < 2 or goes_on(m.start(), m.start() + 1):
                continue
            word = s[max(0, m.start() - LOOK_BACK) : m.start(1)].split()
            if word and word[-1].islower():
                out.append(m.end(1))
        return out

    def _after_quote(self, s: str, mark: str, nxt: int, ch: str) -> bool:
        """Whether a sentence ends with a quotation that ends with `mark`."""
        if not ch:
            return True
        if self.solid:
            return not any(s.startswith(w, nxt) for w in self.reporters)
        if self.cased:
            if not ch.islower():
                return True
            return mark == "."
        word = _UNIT.match(s, nxt)
        return not (word and word[0].rstrip(".") in self.reporters)

    def _is_end(self, s: str, begin: int, p: int, q: int, after: int, mark: str, nxt: int, ch: str) -> bool:
        if self.solid:
            return not (mark == "." and q < len(s) and s[q].isdigit())
        if mark[0] in "…" or mark.startswith(".."):
            return not (self.cased and ch.islower())
        if mark not in ".·":
            return True
        before = _SPLIT_WORD.split(s[max(begin, p - LOOK_BACK) : p])[-1]
        if not before:
            return bool(s[begin:p].strip()) and not ch.islower() if ch else True
        glued = nxt == after and ch != ""
        if before[-1].isdigit():
            if ch == "" :
                return True
            if glued and ch.isalnum():
                return False
            number = _NUMBER.search(s[max(begin, p - LOOK_BACK) : p])
            opening = number is not None and not s[begin : max(begin, p - LOOK_BACK) + number.start()].strip(" \n\"'“„«‘—»")
            if opening or number is not None and number[0].startswith("§"):
                return False
            if number is not None and (NUMBER, self._follower(s, nxt)) in self.collocations:
                return False
            return not ch.islower() if self.cased else self.script != "latn"
        if mark == "·":
            return True
        role = self.abbr.get(before) or self.misread.get(before)
        if role is None and len(before) == 1 and before.isupper():
            role = "A"
        if glued and ch.isalnum():
            if role is not None or len(before) < 2 and self.cased:
                return False
            return ch.isupper() if self.cased else len(before) > 2 and self.script != "deva"
        if role is not None and len(before) > 1 and ch.isalpha() and not ch.islower() and self._opens(before, s, nxt):
            return True
        if role == "A":
            return ch == ""
        if role == "M":
            return ch == "" or not ch.isalpha() or ch.islower() and self.cased
        return True

    def is_abbreviation(self, word: str) -> bool:
        return word in self.abbr or word in self.misread

    def _follower(self, s: str, nxt: int) -> str:
        word = (_WORD if self.cased else _UNIT).match(s, nxt)
        return word[0].rstrip(".").lower() if word else ""

    def _opens(self, before: str, s: str, nxt: int) -> bool:
        """Whether the word at `nxt` opens a sentence though an abbreviation stands before it."""
        word = self._follower(s, nxt)
        return word in self.starters and (before, word) not in self.collocations


def _breaks_paragraph(text: str, ln: Line, nxt: Line, room: int, solid: bool) -> bool:
    if solid:
        return ln.width < 0.55 * room
    left = room - 4 - ln.width
    if left <= 0:
        return False
    words = text[nxt.start : nxt.end].split(None, 2)
    first = len(words[0]) + (1 + len(words[1]) if words[0] == "§" and len(words) > 1 else 0)
    return first <= left


def _join(text: str, lines: list[Line], solid: bool, cased: bool, room: int):
    """The block as one string, the map from its positions to the text's, and its line ends."""
    parts, marks, offsets, breaks, at = [], [], [], [], 0
    last = len(lines) - 1
    for i, ln in enumerate(lines):
        part = text[ln.start : ln.end]
        marks.append(at)
        offsets.append(ln.start)
        if i < last and not solid and part[-1] in BROKEN and len(part) > 1 and part[-2] not in " —":
            part = part[:-1]
            parts.append(part)
            at += len(part)
            continue
        parts.append(part)
        at += len(part)
        if i < last:
            short = _breaks_paragraph(text, ln, lines[i + 1], room, solid)
            if short and cased and not solid:
                head = text[lines[i + 1].start]
                short = not head.islower() and part[-1] not in ",;:—"
            elif short:
                short = part[-1] not in "،,、，"
            breaks.append((at, short))
            if not solid or part[-1].isdigit() or "฀" <= part[-1] <= "๿":
                parts.append("\n")
                at += 1
    return "".join(parts), marks, offsets, breaks


def _statements(text: str, lines: list[Line], splitter: Splitter, room: int) -> list[int]:
    """Ends of an advert's statements: at closing marks, where capitals turn to small letters or
    back, and at lines that leave room for the next word."""
    s, marks, offsets, breaks = _join(text, lines, splitter.solid, False, room)
    ends = set(splitter.ends(s, [(at, short) for at, short in breaks]))
    case = None
    for i, ln in enumerate(lines):
        part = text[ln.start : ln.end]
        # abbreviations keep their small letters amid capitals
        letters = [c for w in part.split() if w[-1] != "." or not splitter.is_abbreviation(w[:-1]) for c in w if c.isalpha()]
        now = None if len(letters) < 2 else sum(c.isupper() for c in letters) > 0.6 * len(letters)
        if i and now is not None and case is not None and now != case:
            ends.add(marks[i] - (1 if marks[i] and s[marks[i] - 1] == "\n" else 0))
        case = case if now is None else now
    return [_back(e, marks, offsets) for e in sorted(ends)]


def _back(e: int, marks: list[int], offsets: list[int]) -> int:
    k = bisect_right(marks, e - 1) - 1
    return offsets[k] + (e - marks[k])


def split_page(text: str | None, boxes: list | None, lang: str | None, model: Model) -> list[int]:
    """Character positions after the last character of each sentence of a page.

    NULL or blank text has none. Every piece of text belongs to a sentence: a heading is one, an
    advert one per statement, and what is left at the end of the page is one too.
    """
    if not text or text.isspace():
        return []
    script, group = group_of(text, lang)
    if script == "latn":
        group = nearest_group(text, group, model)
    splitter = Splitter(model, script, group)
    blocks = read_page(text, boxes)
    widths = sorted(ln.width for kind, lines in blocks if kind == BODY for ln in lines)
    room = widths[min(len(widths) - 1, int(len(widths) * 0.98))] if widths else 0
    out = []
    for kind, lines in blocks:
        if kind == BODY:
            s, marks, offsets, breaks = _join(text, lines, splitter.solid, splitter.cased, room)
            out += [_back(e, marks, offsets) for e in splitter.ends(s, breaks)]
        elif kind == ADVERT:
            aside = min((ln.inset for ln in lines if ln.inset), default=room)
            out += _statements(text, lines, splitter, max([room - aside, *(ln.width for ln in lines)]))
        else:
            out.append(lines[-1].end)
    return out


def nearest_group(text: str, group: str, model: Model) -> str:
    """The Latin group whose most common words the text has most of; the labelled one on a tie. A
    label without common words of its own stands unless the text reads as another group's do."""
    words = Counter(text.split())
    best, most = group, sum(words[w] for w in model.common.get(group, ()))
    doubtful = group != "latn-" and group not in model.common
    for g, common in sorted(model.common.items()):
        n = sum(words[w] for w in common)
        if n > most and not (doubtful and n < FOREIGN_SHARE * model.share.get(g, 0) * words.total()):
            best, most = g, n
    return best


def _boxes(column: pa.Array) -> list:
    """Per row a list of (x0, y0, x1, y1) or None, or None for a row without boxes."""
    valid = column.is_valid().to_pylist()
    offsets = column.offsets.to_pylist()
    flat = column.values
    fields = [flat.field(c).to_pylist() for c in ("x0", "y0", "x1", "y1")]
    present = flat.is_valid().to_pylist()
    boxes = [b if ok and None not in b else None for b, ok in zip(zip(*fields, strict=True), present, strict=True)]
    return [boxes[a:b] if ok else None for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)]


def sentences(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, begin_char, end_char) per sentence of documents (doc_id, text, lang, boxes).

    `end_char` counts the characters of the text up to and including the sentence's last one;
    `begin_char` those before the first one after the end that precedes it in the text (on pages
    read out of order, parts of other sentences may lie between). The model is learned from the
    same documents unless one is given; it is small (MODEL_BOUND) and broadcast. NULL or blank
    texts have no rows; NULL boxes, boxes of another number than lines and a missing `boxes`
    column mean that the text's own order stands.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(documents))
    has_boxes = "boxes" in documents.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in it:
            ids, begins, ends = [], [], []
            boxes = _boxes(batch["boxes"]) if has_boxes else [None] * batch.num_rows
            for doc, text, lang, box in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["lang"].to_pylist(), boxes, strict=True):
                last = 0
                for e in sorted(set(split_page(text, box, lang, known))):
                    ids.append(doc)
                    begins.append(last)
                    ends.append(e)
                    last = e
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, begins, ends)], ["doc_id", "begin_char", "end_char"])

    columns = ["doc_id", "text", "lang", *(["boxes"] if has_boxes else [])]
    return documents.select(*columns).mapInArrow(run, "doc_id long, begin_char long, end_char long")
