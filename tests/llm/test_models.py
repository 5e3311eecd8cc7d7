import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import MEDIUM, SMALL
from tests.llm.samples import SCHEMA, crowded, odd_documents

from netstrata.llm import charmodel, langid, urls


class Plain:
    """The models by the textbook recursion, over a dictionary of each label's counts."""

    def __init__(self, units, order, discount=0.75, fewest=1):
        self.order, self.discount = order, discount
        self.n, self.total, self.types = {}, {}, {}
        letters = set()
        for label in {label for label, _ in units}:
            raw, n = Counter(), Counter()
            for (own, unit), times in units.items():
                for gram in charmodel.grams(unit, order) if own == label else []:
                    raw[gram] += times
            if discount is None:
                for gram, times in raw.items():
                    for at in range(len(gram)):
                        n[gram[at:]] += times
                n = Counter({g: v for g, v in n.items() if v >= fewest or len(g) == 1})
            else:
                n.update(raw)
                for longer in {gram[at:] for gram in raw for at in range(len(gram))}:
                    if len(longer) > 1:
                        n[longer[1:]] += 1
            letters |= {g for g in n if len(g) == 1}
            self.n[label], self.total[label], self.types[label] = n, Counter(), Counter()
            for gram, times in n.items():
                self.total[label][gram[:-1]] += times
                self.types[label][gram[:-1]] += 1
        self.alphabet = len(letters) + 1

    def chance(self, label, gram):
        if not gram:
            return 1 / self.alphabet
        n, total, types = self.n[label][gram], self.total[label][gram[:-1]], self.types[label][gram[:-1]]
        below = self.chance(label, gram[1:])
        if not total:
            return below
        if self.discount is None:
            return (n + types * below) / (total + types)
        return (max(n - self.discount, 0) + self.discount * types * below) / total

    def score(self, label, unit):
        return sum(math.log(self.chance(label, gram)) for gram in charmodel.grams(unit, self.order))


def counts(spark, units, order):
    rows = [(label, gram, n) for (label, gram), n in charmodel.count_units(Counter(units), order).items()]
    return spark.createDataFrame(rows, "label string, gram string, n long")


WORDS = Counter({("a", "banana"): 3, ("a", "bandana"): 1, ("a", "nab"): 2, ("b", "cab"): 4, ("b", "cabana"): 1, ("b", "日本語"): 2})


@pytest.mark.parametrize("most", [charmodel.MOST_BYTES, 0])  # in memory, in files
@pytest.mark.parametrize("order", [1, 3, 4])
def test_models_are_the_recursions(spark, monkeypatch, most, order):
    monkeypatch.setattr(charmodel, "MOST_BYTES", most)
    table, labels = counts(spark, WORDS, order), ["a", "b"]
    for model, plain in (
        (charmodel.kneser_ney(table, order, labels), Plain(WORDS, order)),
        (charmodel.witten_bell(table, order, labels), Plain(WORDS, order, None)),
        (charmodel.witten_bell(table, order, labels, 3), Plain(WORDS, order, None, 3)),
    ):
        units = ["banana", "zoo", "abba", "cab", "", "nabz", "本", "\U0001f600x"]
        sums, sizes = model.score(units)
        assert sizes.tolist() == [len(u) + 1 for u in units]
        for i, unit in enumerate(units):
            assert np.allclose(sums[i], [plain.score(label, unit) for label in labels], atol=1e-9)
        for label in labels:
            for context in ["", "a", "an", "ba", "本"]:
                own = {g for g in plain.n["a"] | plain.n["b"] if len(g) == 1}
                assert abs(sum(plain.chance(label, context[-order + 1 :] * (order > 1) + c) for c in own | {"?"}) - 1) < 1e-9


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = langid.op10_language_id(spark, MEDIUM).collect()
    assert {r.doc_id for r in rows} == set(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_languages_are_not_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(langid.fold() == 0, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.train(langid.training_texts(d)) for d in (docs, spoiled))
    assert a.labels == b.labels and all(np.array_equal(x.keys, y.keys) and np.allclose(x.values, y.values) for x, y in zip(a.known, b.known, strict=True))


def test_language_query_against_the_recursion(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    words = lambda text: [u for w in (text or "").split() if (u := langid.letters(w))]
    where = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in docs}
    units = Counter((r.lang, w) for r in docs if r.lang and where[r.doc_id] in (1, 2, 3) for w in words(r.text))
    plain, labels, known = Plain(units, langid.ORDER), sorted({label for label, _ in units}), {}

    def entropies(text):
        own = words(text)
        for w in own:
            if w not in known:
                known[w] = np.array([plain.score(label, w) for label in labels])
        return -sum(known[w] for w in own) / sum(len(w) + 1 for w in own)

    want, seen = {}, {}
    for r in docs:
        e = entropies(r.text)
        best = int(e.argmin())
        n = sum(len(w) + 1 for w in words(r.text))
        want[r.doc_id] = labels[best], float(e[best]), n, 1 / np.exp(-langid.SHARPNESS * (e - e[best])).sum()
        if r.lang and where[r.doc_id] == langid.CALIBRATION_FOLD and n >= langid.FEWEST_LETTERS:
            seen.setdefault(labels[best], []).append(float(e[best]))
    limits = {label: sorted(own)[math.ceil(langid.CALIBRATION_QUANTILE * len(own)) - 1] for label, own in seen.items()}
    for r in langid.op10_language_id(spark, SMALL).collect():
        label, least, n, share = want[r.doc_id]
        assert (r.lang_pred, r.held_out) == (label, where[r.doc_id] == 0) and abs(r.score - share) < 1e-6
        assert r.accepted == (least <= limits.get(label, max(limits.values())) + langid.SHORT_ALLOWANCE / math.sqrt(n))


def test_scorer_forgets_when_full(spark):
    model = langid.train(spark.createDataFrame([("en", "the quick fox"), ("de", "der schnelle Fuchs")], "label string, text string"))
    texts = ["the fox der Fuchs " * 20, "one two three four five six", None, "7", "quick"]
    whole, small = langid.Scorer(model), langid.Scorer(model, 3)
    for _ in range(2):
        for a, b in zip(whole.entropies(texts), small.entropies(texts), strict=True):
            assert np.allclose(a, b)
    assert len(small.place) <= 6


def test_language_odd_rows(spark):
    docs = crowded(odd_documents(spark), "label", "unit", "n")
    model = langid.train(spark.createDataFrame([("en", "the quick fox"), ("de", "der schnelle Fuchs"), ("de", "und ñ")], "label string, text string"))
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r._lang, r._score, r._letters) == ("und", 0.0, 0)
        else:
            assert r._lang in ("de", "en")
    none = spark.createDataFrame([], SCHEMA)
    assert langid.train(langid.training_texts(none)) is None
    assert langid.predict(none, None).collect() == []
    assert {r._lang for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(none, model).collect() == []


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = langid.train(langid.training_texts(docs))
    limits = langid.calibrate(docs, model)
    strange = spark.createDataFrame([(1, "zxqj vkpw xxqz jjkq wvxz qqpk zzvw kkxj " * 30, "en", "s", 0)], SCHEMA)
    assert langid.predict(strange, model).filter(langid.accepted(limits)).count() == 0
    assert langid.predict(docs, model).filter(langid.accepted(limits)).count() >= 0.999 * docs.count()


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:].split("?")[0].split("#")[0]
    best = max(((n + p, v) for v, n, p in urls.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


ODD_URLS = [None, "", "no scheme/x", "http://", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=/es/#y", "http://example.org/en/2", "http://org/a", "http://notorg/a", "http://x.com/fr/", "http://x.com/fr", "http://X.com?q=1/fr/", "http://x.com#f", "http://é.com/de/ü", "ftp://a://b.org/c", "http://a\nb.org/x\ny", "http://u:p@x.com:80/de/", "http://x.com/de/1"]


def test_url_rules(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_URLS)), "page_id long, url string")
    for r in urls.ruled(crowded(rows, "host", "path", "rule")).collect():
        assert (r.host, r.path, r.rule, r.ruling) == plain_rule(ODD_URLS[r.page_id])
    judged = {r.page_id: r for r in urls.judge(rows).collect()}
    assert len(judged) == len(ODD_URLS) and judged[0].verdict == "allow"
    assert urls.judge(rows.filter("false")).collect() == []


def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    rows = urls.op1_url_filter(spark, MEDIUM).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        host, path, rule, ruling = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == ruling if ruling else r.verdict in ("allow", "block")
        assert (r.ratio is None) == (ruling is not None)


def test_url_models_tell_kinds_apart(spark):
    good = [(i, f"http://library{i % 30}.org/books/{i}") for i in range(300)]
    bad = [(1000 + i, f"http://casino{i % 30}.com/de/win-{i}") for i in range(300)]
    new = [(5001, "http://library99.net/books/7"), (5002, "http://casino99.net/de/win-7")]
    rows = spark.createDataFrame(good + bad + new, "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(rows).collect()}
    assert verdicts[5001] == "allow" and verdicts[5002] == "block"
    scored = urls.cross_scored(urls.ruled(rows))
    found = {r.ruling: (r.n, r.n_below) for r in urls.report(scored, urls.calibrate(scored)).collect()}
    assert found["allow"][0] == 300 and found["allow"][1] <= 6 and found["block"] == (300, 300)


def test_url_query_against_the_recursion(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    parts = {i: plain_rule(url) for i, url in pages.items()}
    unit = {i: parts[i][0] + re.sub(r"(?s)^.*?://[^/?#]*", "", url) if url and "://" in url else "" for i, url in pages.items()}
    fold = {i: zlib.crc32(parts[i][0].encode()) % urls.FOLDS for i in pages}

    def ratios(learn, score):
        plain = Plain(Counter((parts[i][3], unit[i]) for i in learn if parts[i][3]), urls.ORDER, None, urls.FEWEST)
        return {i: (plain.score("allow", unit[i]) - plain.score("block", unit[i])) / (len(unit[i]) + 1) for i in score}

    seen = {}
    for f in range(urls.FOLDS):
        learn = [i for i in pages if fold[i] != f]
        if {parts[i][3] for i in learn} >= {"allow", "block"}:
            seen |= ratios(learn, [i for i in pages if fold[i] == f and parts[i][3]])
    buckets = {kind: sorted(max(-urls.BUCKETS, min(urls.BUCKETS, math.floor(r / urls.STEP))) for i, r in seen.items() if parts[i][3] == kind) for kind in ("allow", "block")}
    low = buckets["allow"][math.floor(urls.MOST_LOST * len(buckets["allow"]))]
    high = buckets["block"][::-1][math.floor(urls.MOST_LOST * len(buckets["block"]))] + 1 if buckets["block"] else low
    limit = (low if high >= low else (low + high) / 2) * urls.STEP
    ratio = ratios(list(pages), list(pages))
    for r in urls.op1_url_filter(spark, SMALL).collect():
        host, path, rule, ruling = parts[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (ruling or ("block" if ratio[r.page_id] < limit and host else "allow"))
        assert ruling or abs(r.ratio - ratio[r.page_id]) < 1e-9


def test_models_keep_every_gram(spark):
    texts = spark.range(160_000).selectExpr("'xx' as label", "concat(decode(unhex(hex(19968 + int(id % 400))), 'UTF-16BE'), decode(unhex(hex(20968 + int(id / 400))), 'UTF-16BE'), '一') as text")
    model = langid.train(texts)
    assert len(model.known[3]) == 320_000
