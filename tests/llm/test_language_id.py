import math
import random
import re

from ctxvote.llm.html_text import host_of, text_by_rules
from ctxvote.llm.language_id import CUE_WEIGHT, EVIDENCE, HOST_WEIGHT, _cue_table, domain_of, fit_text, identify, suffix_of, trigrams


def test_evidence_is_fused(spark):
    en, fr = "the house and the garden with the tree", "la maison et le jardin avec les arbres"
    docs = spark.createDataFrame([(i, f"{en if i % 2 else fr} {i}", "en" if i % 2 else "FR") for i in range(40)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    rows = [(i, f"http://a.com/{'en' if i % 2 else 'fr'}/{i}", f"<html lang='{'en' if i % 2 else 'fr'}'><p>{en if i % 2 else fr}</p>") for i in range(20)]
    rows += [(100 + i, f"http://b.fr/{i}", f"<html><p>{fr}</p>") for i in range(6)] + [(200, "http://b.fr/x", "<html><p>zzz</p>"), (201, "http://a.com/en/9", None), (202, None, ""), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, lang string")
    got = identify(pages, docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang == ("en" if i % 2 else "fr") for i in range(20))
    assert by[200].lang == "fr" and by[201].lang == "en" and by[202].lang in ("en", "fr")  # the host, then the path decides
    assert all(0.5 <= r.probability <= 1 for r in got)
    assert identify(pages.limit(0), docs).collect() == []
    assert identify(pages, docs.limit(0)).first().lang is None


def test_parts():
    assert [suffix_of(u) for u in ("http://a.com/fr/1", "https://x.de/long", "http://a.com/de-at?x", None, "http://1.2.3.4/")] == ["fr", ".de", "de", "", ""]
    assert domain_of("www.a.co") == "a.co" and trigrams("Ab a")[" a "] == 1


def test_a_rare_language_outlives_the_fit_bound(spark):
    rows = [(i, "the house and the garden", "en") for i in range(300)] + [(1000 + i, "la maison et le jardin", "fr") for i in range(2)]
    rows += [(2000, "!!", "de")]  # no trigrams: the smoothed model alone
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table, unknown = fit_text(docs, fit_rows=1)
    assert langs == ["de", "en", "fr"] and len(unknown) == 3
    en, fr = (table[" la"][langs.index(x)] for x in ("en", "fr"))
    assert fr > en


def test_rare_cues_keep_their_evidence(spark):
    rows = [(f"c{i}", [0.0, 1.0] if i == 1199 else [1.0, 0.0]) for i in range(1200) for _ in range(1 + (i < 1100))]
    got = {r.suffix: (r.suffix_s, r.suffix_n) for r in _cue_table(spark.createDataFrame(rows, "suffix string, p array<double>"), "suffix", 2).collect()}
    assert len(got) == 1200
    assert got["c1199"] == ([0.0, 1.0], 1) and got["c0"] == ([2.0, 0.0], 2)


def softmax(x):
    top = max(x)
    p = [math.exp(v - top) for v in x]
    return [v / sum(p) for v in p]


def brute(rows, docs):
    """The fusion in plain Python, page against pages."""
    langs, table, unknown = fit_text(docs)
    n = len(langs)
    logs, cues = [], []
    for _, url, html in rows:
        grams = trigrams(text_by_rules(html))
        total = sum(grams.values())
        sums = [sum(times * table.get(g, unknown)[i] for g, times in grams.items()) for i in range(n)]
        logs.append([s * min(1.0, EVIDENCE / total) for s in sums] if total else sums)
        m = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", html or "")
        cues.append((m[1].lower() if m else "", suffix_of(url), host_of(url), domain_of(host_of(url))))
    p = [softmax(x) for x in logs]
    world = [max(sum(x[i] for x in p) / len(p), 1e-9) for i in range(n)]
    out = []
    for k in range(len(rows)):
        scores = list(logs[k])
        same = lambda c: [p[j] for j in range(len(rows)) if j != k and cues[j][c] == cues[k][c]]  # noqa: B023, E731
        for i in range(n):
            for c in (0, 1):
                others = same(c)
                scores[i] += math.log((sum(x[i] for x in others) + CUE_WEIGHT * world[i]) / ((len(others) + CUE_WEIGHT) * world[i]))
            domain = (sum(x[i] for x in same(3)) + HOST_WEIGHT * world[i]) / (len(same(3)) + HOST_WEIGHT)
            scores[i] += math.log((sum(x[i] for x in same(2)) + HOST_WEIGHT * domain) / (len(same(2)) + HOST_WEIGHT))
        q = softmax(scores)
        out.append((langs[q.index(max(q))], max(q)))
    return out


def planted(n=160):
    """Pages of four invented languages with noisy declarations and hosts, some without any text of their own."""
    rng = random.Random(4)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(60)] for lang, letters in (("da", "aeiourstln"), ("en", "aeihwthpqz"), ("fr", "uoilmnvqx"), ("it", "aoiecrgtz"))}
    text = lambda lang, k: " ".join(rng.choice(vocabulary[lang]) for _ in range(k))
    docs = [(i, text(lang, 40), lang) for i, lang in enumerate(sorted(vocabulary) * 30)]
    rows, truth = [], []
    for i in range(n):
        lang = rng.choice(sorted(vocabulary))
        said = lang if rng.random() < 0.8 else "en"
        words = rng.choice([0, 0, 1, 3, 30, 4000 if i == 7 else 60])
        rows.append((i, f"http://{rng.choice(['www', 'm'])}.{lang if rng.random() < 0.9 else 'en'}{rng.randint(0, 2)}.com/{said}/{i}", f"<html lang={said}><body><p>{text(lang, words)}</p></body></html>"))
        truth.append(lang)
    return docs, rows, truth


def test_against_brute_force_and_planted_languages(spark):
    docs, rows, truth = planted()
    rows += [(500, None, None), (501, "", ""), (502, "http://new.xx/", "<p></p>"), (3, rows[3][1], rows[3][2])]
    d = spark.createDataFrame([*docs, (None, "no id " * 30, "en"), (900, None, "fr")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(*r, "x", 1.0, "y") for r in rows], "page_id long, url string, html string, lang string, p double, host string").repartition(3)
    got = identify(pages, d).collect()
    want = brute(rows, d)
    pairs = list(zip(sorted((r.page_id, r.lang, r.probability) for r in got), sorted((i, x, q) for (i, _, _), (x, q) in zip(rows, want, strict=True)), strict=True))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in pairs)
    by = {r.page_id: r for r in got}
    right = sum(by[i].lang == lang for i, lang in enumerate(truth)) / len(truth)
    text_only = sum(by[i].text_lang == lang for i, lang in enumerate(truth)) / len(truth)
    assert right > 0.85 and right > text_only + 0.1  # evidence beside the text decides pages without any


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same words here", "en"), (2, "same words here", "de"), (3, "same words here", "fr")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>same words</p>"), (2, None, None)], "page_id long, url string, html string")
    assert [r.lang for r in identify(pages, docs).collect()] == ["de", "de"]
