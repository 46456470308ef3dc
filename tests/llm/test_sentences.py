import random

import pytest

from tickloom.llm import layout as L
from tickloom.llm import sentences as S

WORDS = "the of lorn marsh dell bray corin tesk valen oster pradel umber quill senna torb ive galt hesper linnet moray".split()
NAMES = ["Otvarr", "Kelm", "Zubrin", "Havlock"]


def corpus(n=400, seed=1):
    """Texts with titles that stand before names, and abbreviations that end sentences."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sents = []
        for _ in range(rng.randint(3, 9)):
            words = [rng.choice(WORDS) for _ in range(rng.randint(4, 9))]
            if rng.random() < 0.3:
                words.insert(rng.randint(1, len(words) - 1), rng.choice(["Dr.", "approx.", "J."]) + " " + rng.choice(NAMES))
            s = " ".join(words)
            s = s[0].upper() + s[1:]
            if rng.random() < 0.12:
                s = f"{rng.randrange(99)}.{rng.randrange(10, 99)} " + s
            elif rng.random() < 0.15:
                s = '"' + s
            s += rng.choice([".", ".", ".", "!", "?", " Co."])
            sents.append(s + ('"' if s[0] == '"' else ""))
        out.append((i, " ".join(sents), "en"))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return S.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))


def split(text, model, boxes=None, lang="en"):
    at, out = 0, []
    for e in sorted(S.split_page(text, boxes, lang, model)):
        out.append(text[at:e].strip())
        at = e
    return out


def test_learned_abbreviations(model):
    got = model.abbreviations["latn-en"]
    assert got.get("Dr") == "A" and got.get("approx") == "A" and "Co" not in got
    assert not set(got) & set(WORDS)


def test_held_out_sentences(spark, model):
    docs = corpus(60, 9)
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, lang string, source string, end_char int")
    got = {}
    for r in S.sentences(frame, model).collect():
        got.setdefault(r["doc_id"], set()).add(r["end_char"])
    good = found = true = 0
    for i, text, _ in docs:
        ends = set()
        for m in S.re.finditer(r'(?:[.!?]"?)(?= |$)', text):
            word = text[: m.start()].split(" ")[-1].strip('"')
            if word in ("Dr", "approx", "J") or text[: m.end()].count('"') % 2:
                continue
            ends.add(m.end())
        good += len(ends & got[i])
        found += len(got[i])
        true += len(ends)
    assert good / found > 0.97 and good / true > 0.97


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The marsh of Dr. Otvarr lorn. Umber galt approx. Kelm torb the Co. Senna ive.", ["The marsh of Dr. Otvarr lorn.", "Umber galt approx. Kelm torb the Co.", "Senna ive."]),
        ("Lorn 3.14 dell 2,5 bray. .29 Tesk marsh.", ["Lorn 3.14 dell 2,5 bray.", ".29 Tesk marsh."]),
        ('"Lorn the dell?" said Kelm of the. Bray!', ['"Lorn the dell?" said Kelm of the.', "Bray!"]),
        ("“Lorn the dell.” Bray the “umber galt”. Tesk (quill!) marsh.", ["“Lorn the dell.”", "Bray the “umber galt”.", "Tesk (quill!) marsh."]),
        ("Lorn dell... bray the... Tesk.", ["Lorn dell... bray the...", "Tesk."]),
        ("Lorn dell.Bray tesk?Umber.", ["Lorn dell.", "Bray tesk?", "Umber."]),
        ("Lorn dell· Bray.—Tesk marsh", ["Lorn dell·", "Bray.", "—Tesk marsh"]),
        ("umber galt. lorn", ["umber galt.", "lorn"]),
        ("§ 57. Lorn the § 60. dell 44. bray.", ["§ 57. Lorn the § 60. dell 44. bray."]),
        ("...", []),
    ],
)
def test_marks_in_context(model, text, want):
    assert split(text, model) == want


def test_other_scripts(model):
    assert split("城港桥少。方新「河厂。」完的！", model, lang="zh") == ["城港桥少。", "方新「河厂。」", "完的！"]
    assert split("城港桥少　方新河厂　完的", model, lang="zh") == ["城港桥少", "方新河厂", "完的"]
    assert split("नगर रखा है। एक लाल| दो बं॥", model, lang="hi") == ["नगर रखा है।", "एक लाल|", "दो बं॥"]
    assert split("کا شہر ہے۔ وہ دان کیا؟ اور", model, lang="ur") == ["کا شہر ہے۔", "وہ دان کیا؟", "اور"]
    assert split("Γογο στο λη; Καρά δεν.", model, lang="el") == ["Γογο στο λη;", "Καρά δεν."]
    assert split("เรือแล้ว ว่าสะพาน 12 โรงๆ รถ", model, lang="th") == ["เรือแล้ว", "ว่าสะพาน 12 โรงๆ รถ"]


def test_nulls_blanks_long_texts_and_missing_boxes(spark, model):
    assert S.split_page(None, None, None, model) == [] == S.split_page(" \n\n ", [], None, model)
    long = "Lorn the dell. " * 60_000
    assert len(S.split_page(long, None, "en", model)) == 60_000
    rows = [(1, None, None), (2, "", "en"), (3, "Lorn dell.\nBray", None), (None, "Tesk.", "xx"), (3, "Lorn dell.\nBray", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((str(r["doc_id"]), r["end_char"]) for r in S.sentences(df, model).collect()) == [("3", 10), ("3", 10), ("3", 15), ("3", 15), ("None", 5)]
    assert S.sentences(df.limit(0)).count() == 0
    boxes = df.selectExpr("doc_id", "text", "lang", "array(named_struct('x0', 1, 'y0', 2, 'x1', 3, 'y1', 4, 'conf', cast(null as float)), null) as boxes")
    assert S.sentences(boxes, model).count() == 5
    assert S.sentences(boxes.selectExpr("doc_id", "text", "lang", "if(doc_id = 3, null, boxes) as boxes"), model).count() == 5


def box(x, y, n, h=22):
    return (x, y, x + 12 * n, y + h)


def page(lines):
    """lines: (x, y, text, height or None for no box) in reading order of the scanner."""
    return "\n".join(t for _, _, t, _ in lines), [None if h is None else box(x, y, len(t), h) for x, y, t, h in lines]


def test_columns_read_across_and_out_of_order(model):
    left = ["Lorn the dell of umber galt tes-", "k marsh quill. Bray the valen of", "corin oster hesper linnet and ivy"]
    right = ["moray torb senna. Galt umber the", "dell. Tesk"]
    a = [(100, 100 + 34 * i, t, 22) for i, t in enumerate(left)]
    b = [(600, 101 + 34 * i, t, 22) for i, t in enumerate(right)]
    for order in (a + b, b + a, [x for p in zip(a, b, strict=False) for x in p] + a[2:]):
        text, boxes = page(order)
        blocks = L.read_page(text, boxes)
        assert [text[ln.start : ln.end] for _, ls in blocks for ln in ls] == left + right
        ends = {text[:e].split("\n")[-1] for e in S.split_page(text, boxes, "en", model)}
        assert ends == {"k marsh quill.", "moray torb senna.", "dell.", "dell. Tesk"}


def test_headings_adverts_and_paragraph_ends(model):
    lines = [
        (110, 100, "LORN OF THE MARSH", 30), (110, 134, "UMBER", 30), (100, 168, "Dell the bray of corin tesk val-", 22),
        (140, 202, "QUILL OSTER 2.50", 24), (140, 236, "galt the moray.", 20), (100, 270, "en oster quill and hesper Co.", 22), (100, 304, "torb senna", 22),
        (100, 338, "Linnet ive galt the umber marsh", 22), (110, 372, "Senna Torb", 30), (100, 406, "Ive the dell.", 22),
    ]
    text, boxes = page(lines)
    got = {text[:e].split("\n")[-1] for e in S.split_page(text, boxes, "en", model)}
    assert got == {"UMBER", "QUILL OSTER 2.50", "galt the moray.", "en oster quill and hesper Co.", "torb senna", "Linnet ive galt the umber marsh", "Senna Torb", "Ive the dell."}


def test_lines_side_by_side_and_lines_without_boxes(model):
    text = "Lorn the dell of um-   Tesk marsh the bray\nber galt. Valen the   of corin. Oster qui-\nmoray.   ll senna."
    boxes = [(100, 100 + 34 * i, 900, 122 + 34 * i) for i in range(3)]
    ends = [text.index(x) + len(x) for x in ("ber galt.", "moray.", "of corin.", "ll senna.")]
    assert sorted(S.split_page(text, boxes, "en", model)) == sorted(ends)
    lines = [(100, 100, "Lorn the dell of umber galt.", 22), (0, 0, "Bray the marsh of tesk valen.", None), (100, 168, "Quill.", 22)]
    text, boxes = page(lines)
    assert len(S.split_page(text, boxes, "en", model)) == 3


def test_batches_and_partitions_do_not_matter(spark, model):
    df = spark.createDataFrame(corpus(50, 3), "doc_id long, text string, lang string")
    one = sorted(map(tuple, S.sentences(df.coalesce(1), model).collect()))
    assert one == sorted(map(tuple, S.sentences(df.repartition(9), model).collect()))
    counts = [sorted(map(tuple, S.statistics(df.repartition(n)).collect())) for n in (1, 6)]
    assert counts[0] == counts[1]


def test_starters_and_collocations_settle_each_period(spark):
    rng = random.Random(5)
    docs = []
    for i in range(400):
        sents = []
        for _ in range(8):
            words = [rng.choice(WORDS) for _ in range(6)]
            pick = rng.random()
            if pick < 0.25:
                words.insert(3, "Inc. " + rng.choice(NAMES))
            elif pick < 0.35:
                words.append("Inc")
            elif pick < 0.5:
                words.insert(3, "Dr. Yet")
            elif pick < 0.65:
                words.insert(3, f"{rng.randrange(9)}. Tarsk")
            elif pick < 0.75:
                words.append(f"{rng.randrange(1800, 1900)}")
            sents.append(" ".join([rng.choice(["Yet", "Thus", "Soon"]), *words]) + ".")
        docs.append((i, " ".join(sents), "en"))
    model = S.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert {"Inc", "Dr"} <= set(model.abbreviations["latn-en"])
    assert {"yet", "thus", "soon"} == model.starters["latn-en"]
    assert {("Dr", "yet"), ("#", "tarsk")} == model.collocations["latn-en"]
    # the same abbreviation or number ends a sentence before a starter, not before another word
    text = "Thus lorn Inc. Kelm dell galt Inc. Yet the marsh Dr. Yet bray. Soon 3. Tarsk dell 1850. Thus ive."
    want = ["Thus lorn Inc. Kelm dell galt Inc.", "Yet the marsh Dr. Yet bray.", "Soon 3. Tarsk dell 1850.", "Thus ive."]
    assert split(text, model) == want


def test_small_latin_languages_keep_their_model_and_wrong_labels_do_not(spark):
    rng = random.Random(3)
    shared = ["de", "la", "in"]
    letters = "bdfgklmnprst"
    large = [a + "a" + b for a in letters for b in "lnr"] + shared
    small = [a + "u" + b for a in letters for b in "lnr"] + shared
    name = ["Otvarr", "Kelm", "Zubrin"]

    def text(words, abbreviation):
        return " ".join(f"{' '.join(rng.choices(words, k=5)).capitalize()} {abbreviation}. {rng.choice(name)} {' '.join(rng.choices(words, k=5))}." for _ in range(30))

    docs = [(i, text(large, "Dr"), "en") for i in range(300)] + [(500 + i, text(small, "Hr"), "lv") for i in range(4)] + [(600 + i, text(large, "Dr"), "ja") for i in range(4)]
    model = S.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert set(model.common) == {"latn-en", "latn-lv"} and "Hr" in model.abbreviations["latn-lv"]
    page = "Bul fur de la Hr. Kelm gun. Lur nul."
    assert S.nearest_group(page, "latn-lv", model) == "latn-lv" and split(page, model, lang="lv") == ["Bul fur de la Hr. Kelm gun.", "Lur nul."]
    assert S.nearest_group("Bal far de la Dr. Kelm gan. Lar nal tar.", "latn-ja", model) == "latn-en"
    # too little is known of this label: one common word doesn't make the text another language's
    assert S.nearest_group("Oxo ypo ozo de oko epo uko iko oto epi.", "latn-xx", model) == "latn-xx"
    assert S.nearest_group("Oxo ypo ozo de oko epo uko iko oto epi.", "latn-", model) == "latn-en"


def test_rare_reporting_words_of_solid_scripts(spark):
    rng = random.Random(8)
    han = "城港桥少方新河厂完的山水风云"
    docs = []
    for i in range(200):
        word = lambda: "".join(rng.choices(han, k=6))
        said = "他说" if i % 10 else "她喊"  # one in ten of them is rare
        said = "王问" if i % 50 == 3 else said
        # quotations that follow each other, and sentences that begin with a single character before a comma
        docs.append((i, f"{word()}。「{word()}。」{said}{word()}。" * 4 + f"{word()}。" * 4 + f"「{word()}。」「{word()}。」{rng.choice(han)}，{word()}。{rng.choice(han)}，{word()}。", "zh"))
    model = S.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.reporters["hani"] == {"他说", "她喊", "王问"}  # the last after 2 % of the quotations
    assert split("城港。「河厂。」王问完的。", model, lang="zh") == ["城港。", "「河厂。」王问完的。"]
