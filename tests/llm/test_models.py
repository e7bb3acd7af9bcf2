import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismara.llm import langid, quality


def test_language_of_held_out_texts(spark):
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éèabz"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang) for i, lang in enumerate(list(letters) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    got = langid.identify(df.where("doc_id % 4 = 2"), model, keep=("doc_id", "lang")).collect()
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] and 0 <= r["score"] <= 1 for r in got)
    noise = langid.identify(spark.createDataFrame([(1, "qwrt plkj mnbv xyxw qqqq ppppp rrrrt")], "doc_id long, text string"), model).first()
    assert noise["rejected"]


def test_language_odd_rows(docs, empty, rows):
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 7}
    assert all((r["lang_pred"] == "und") == (not (text[r["doc_id"]] or "").strip()) for r in got if r["doc_id"] in text)
    assert langid.identify(empty, model).collect() == []
    none = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def characters(text):
    """A text's characters as the models see them, after three marks."""
    out = []
    for c in text + "\n":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\1"
        if c != "\1" or not out or out[-1] != "\1":
            out.append(c)
    return "\1" * 3 + "".join(out[1:] if out[0] == "\1" else out)


def kneser_ney(texts):
    """p(character, context) by dictionaries and recursion."""
    grams = {4: Counter(x[i - 3 : i + 1] for x in map(characters, texts) for i in range(3, len(x)))}
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discount, total, kinds = {}, {}, {}
    for k, count in grams.items():
        once, twice = (sum(1 for n in count.values() if n == m) for m in (1, 2))
        discount[k] = min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)
        total[k], kinds[k] = Counter(), Counter()
        for g, n in count.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(c, context):
        k = len(context) + 1
        below = p(c, context[1:]) if context else 1 / langid.ALPHABET
        if not total[k][context]:
            return below
        taken = max(grams[k][context + c] - discount[k], 0) if grams[k][context + c] else 0
        return taken / total[k][context] + discount[k] * kinds[k][context] / total[k][context] * below

    return p


TONGUES = {"aa": "the cat sat on the mat and the hat was that of the cat", "bb": "été là où naïve élève a été", "cc": "日本語の本 и другой язык 𐐨𐐩 𐐪", "dd": "𞤀𞤁𞤂 𞤃𞤄 𞤀𞤁"}


def test_cross_entropy_and_choice_are_those_of_plain_kneser_ney():
    rng = random.Random(6)
    learned = {k: [" ".join(rng.choices(v.split(), k=12)) for _ in range(30)] for k, v in TONGUES.items()}
    model = langid.Model({k: langid.estimate([x.encode() for x in v]) for k, v in learned.items()})
    plain = {k: kneser_ney(v) for k, v in learned.items()}
    texts = [x[0] + " " + x[1][:9] + "! 12" for x in learned.values()] + ["", " 1 ", "q", "the", "THE été", "𐐨", "ﬀ ẞ x", "no such words"]
    entropy, size, letters = model.cross_entropy([x.encode() for x in texts])
    for i, x in enumerate(texts):
        seen = characters(x)
        assert size[i] == len(seen) - 3 and letters[i] == sum(c.isalpha() for c in x)
        want = [-sum(math.log(plain[k](seen[j], seen[j - 3 : j])) for j in range(3, len(seen))) / max(len(seen) - 3, 1) for k in model.names]
        assert np.allclose(entropy[i], want, atol=1e-4)
        if x and letters[i]:
            assert model.predict([x.encode()])[0][0] == model.names[int(np.argmin(want))]


def test_probabilities_sum_to_one():
    p = kneser_ney(["the cat sat on the mat", "the hat that sat", "été"])
    seen = sorted(set(characters("the cat sat on the mat the hat that sat été")))
    for context in ("the", "qqq", "t\1s", "hat"):
        assert abs(sum(p(c, context) for c in seen) + p("日", context) * (langid.ALPHABET - len(seen)) - 1) < 1e-9


def test_scripts_beyond_16_bits_are_told_apart_and_noise_is_rejected(spark):
    rng = random.Random(9)
    letters = {"x": "𐐨𐐩𐐪𐐫𐐬", "y": "𞤢𞤣𞤤𞤥𞤦"}
    word = lambda k: "".join(rng.choice(letters[k]) + rng.choice("ab") for _ in range(3))
    rows = [(i, " ".join(word(k) for _ in range(40)), k) for i, k in enumerate("xy" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    got = langid.identify(df.where("doc_id % 4 = 2"), model, keep=("doc_id", "lang")).collect()
    assert len(got) == 30 and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in got)
    noise = ["".join(rng.choice("qwertzuiop ") for _ in range(n)) for n in (6, 12, 30, 300)]
    assert langid._predicted(pa.array(noise), model)[2].all()


def test_rejection_rates_of_held_out_texts():
    """Few texts of a language, of any length, are rejected, and hardly any whose characters are mixed up."""
    rng = random.Random(12)
    words = ["".join(rng.choice(x) for x in ("bdfgklmnprst", "aeiou", "lmnrst")) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    own = langid.estimate([text(60).encode() for _ in range(200)])
    own.bound = langid.calibrate(own, [text(60).encode() for _ in range(60)])
    model = langid.Model({"x": own})
    short = [text(rng.randrange(1, 60)) for _ in range(400)]
    assert langid._predicted(pa.array(short), model)[2].mean() <= 0.02
    mixed = ["".join(rng.sample(x, len(x))) for x in short if len(x) > 60]
    assert langid._predicted(pa.array(mixed), model)[2].mean() >= 0.99


def test_columns_of_any_name_come_through(docs, rows):
    model = langid.fit(docs, F.lit(True))
    keep = tuple(docs.columns)
    assert sorted(langid.identify(docs, model, keep=keep).columns) == sorted(keep)
    left = langid.accepted(docs, model)
    assert left.columns == docs.columns
    said = {repr(r["text"]): r["rejected"] for r in langid.identify(docs, model, keep=("text",)).collect()}
    assert sorted(repr(tuple(r)) for r in left.collect()) == sorted(repr(tuple(r)) for r in docs.collect() if not said[repr(r["text"])])
    assert sorted(quality.score(docs, (np.zeros(quality.SIZE, np.float32), 0.0), keep=keep).columns) == sorted(keep)


def by_hand(texts, labels, passes=quality.PASSES, alpha=1.0, beta=1.0, l1=0.01, l2=0.1):
    """FTRL-proximal with a dictionary, a feature at a time."""
    z, n, bias, bias_n = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    seen = []
    for x, y in zip(texts, labels, strict=True):
        count = Counter(quality.features([x])[0].tolist())
        seen.append(({f: c / sum(count.values()) for f, c in count.items()}, y))
    for _ in range(passes):
        for x, y in seen:
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-(quality.SCALE * sum(w[f] * v for f, v in x.items()) + bias))) - y
            for f, v in x.items():
                d = quality.SCALE * g * v
                z[f] += d - (math.sqrt(n[f] + d * d) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += d * d
            bias_n += g * g
            bias -= g / (1 + math.sqrt(bias_n))
    return {f: weight(f) for f in z}, bias


def test_weights_and_scores_are_those_of_scalar_ftrl():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("good", "fine", "Word", "BAD!!", "buy", "12")) for _ in range(rng.randrange(0, 12))).encode() for _ in range(60)]
    labels = [int(b"good" in x) for x in texts]
    w, bias = quality.train(texts, labels)
    want, want_bias = by_hand(texts, labels)
    assert abs(bias - want_bias) < 1e-6 and np.allclose([w[f] for f in want], list(want.values()), atol=1e-5)
    assert set(np.flatnonzero(w)) <= set(want)
    for x, got in zip(texts, quality.score_texts(texts, w, bias), strict=True):
        f = quality.features([x])[0].tolist()
        mean = sum(want[i] for i in f) / max(len(f), 1)
        assert abs(got - 1 / (1 + math.exp(-(quality.SCALE * mean + want_bias)))) < 1e-5


def test_quality_learns_and_scores_whole_tables(spark):
    rng = random.Random(4)
    good = lambda: " ".join(f"word{rng.randrange(50)}" for _ in range(40))
    bad = lambda: " ".join(f"NO{rng.randrange(500)}!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, F.col("doc_id") % 5 != 0)
    got = quality.score(df, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] % 5 == 0)
    again = quality.fit(df.repartition(7), labels.repartition(5), F.col("doc_id") % 5 != 0)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]


def test_quality_odd_rows(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and {r["score"] for r in got} == {0.5}
    assert quality.score(empty, model).collect() == []
