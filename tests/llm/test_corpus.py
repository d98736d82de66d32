"""Brute-force versions and edge cases of the corpus operators."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, html_blocks, langid, license_scan, mixing, pii, quality, queries, simhash, toxicity, url_rules
from larkspur.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `Text_Length` int, fp string, row string"
RNG = random.Random(5)
VOCABULARY = [a + b + c for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "ve", "no") for c in ("", "s", "nd", "lly")]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(300)
    long = prose(9000)
    made = [base, base, base + " tail", long, "", None, " \n\t ", "one", "a b", "Ünïcode wörds " * 40, "x " * 400, "### $$$ %%% " * 30, prose(120) + "\n" + prose(30) + "\n" + prose(30)]
    made += [prose(80 + i) for i in range(40)] + [base.replace(" ", "  ", 3).upper()]
    out = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s2"][i % 4], len(t or ""), 7, "clash", None) for i, t in enumerate(made)]
    return [*out, out[0], (None, base, None, None, 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_statistics(docs, rows, empty):
    def brute(t):
        w = spaced(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    got = quality.quality_report(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_report(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_rejects_outliers(spark):
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice(VOCABULARY) + str(rng.randrange(500)) for _ in range(rng.randrange(80, 300))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in t.split()), "en", "s") for i, t, _, _ in clean[:5]]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i] for i in range(5))
    assert sum(got[i] for i in range(300)) >= 298


def brute_print(t):
    w = spaced(low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, empty):
    prints = [brute_print(r[1]) for r in rows]
    want = collections.Counter(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], classes([r[0] for r in rows], prints), strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_keep_every_class(spark, crowd):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(40)} | {centre}
    for _ in range(60):
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.links(df, crowd=crowd)).collect()}
    got = [parts.get(s, s) for s in signed]
    want = classes(list(range(len(prints))), prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def brute_contamination(text, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, low(text))
    hit, names = set(), set()
    for name, t in items:
        x = re.findall(word, low(t))
        k = min(13, len(x))
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                if name is not None:
                    names.add(str(name))
    n = len(hit)
    return len(w), n, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, rows, empty, block_bytes):
    w = rows[3][1].split()
    items = [(1, " ".join(w[100:140])), (2, "One"), (3, None), (4, ""), (None, " ".join(rows[20][1].split()[5:30])), (11, "A, B!"), (12, " ".join(w[120:160]).upper()), (1, " ".join(w[100:140])), (5, prose(50))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(docs, bench, block_bytes=block_bytes).collect()
    want = collections.Counter((r[0], *brute_contamination(r[1], items)) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    assert next(r["longest_match"] for r in got if r["doc_id"] == 3) >= 40
    assert decontaminate.contamination_report(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_mixing(docs, rows, empty):
    got = mixing.mixing_report(docs).collect()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (r["position"] is not None) == (r["taken"] > 0)
    order = sorted((s for s in size if s is not None)) + [None]
    want = mixing.water_fill([size[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(size.values()))
    assert [target[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mixing_report(docs.repartition(5), slice_rows=3).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))
    assert mixing.mixing_report(empty).count() == 0


def brute_base(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_personal_data_base():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@+ -(9é0%_") for _ in range(rng.randrange(60))) + rng.choice(["", " 4111 1111-1111 1111", " x@y.zz", " 1.2.3.4.5", " +1 (017) 555-7713"])
        assert pii.base_spans(t) == brute_base(t)


def test_personal_data(spark, docs, rows, empty):
    extra = [(500 + i, f"words pin = \"{'0123456789abcdef'[i]}{i}ab45cd78ef9{i}12\" and more ö", "en", "s", 1, 1, None, None) for i in range(8)]
    extra += [(600, "words pin = \"short77\" and 4111111111111111", "en", "s", 1, 1, None, None), (601, "Note: plain words note: other words", "en", "s", 1, 1, None, None)]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {r["doc_id"]: r for r in pii.personal_report(both).collect()}
    assert got[600]["n_card"] == 1 and got[600]["n_context"] == 1 and got[601]["n_context"] == 0
    text = extra[8][1]
    a = text.index("short77")
    assert got[600]["spans"].endswith(f"context:{a}:{a + 7}")
    masked = {r["doc_id"]: r for r in pii.mask(both).collect()}
    assert masked[600]["text"] == 'words pin = "<CONTEXT>" and <CARD>' and masked[600]["n_chars"] == len(masked[600]["text"])
    assert masked[5]["text"] is None and pii.personal_report(empty).count() == 0


def test_personal_data_long_tokens_and_word_contexts(spark):
    long = "".join("0123456789abcdef"[i * 7 % 16] for i in range(320))
    texts = [f'say token = "{long[i:]}a" now' for i in range(4)]
    texts += [f"you may call +1 (017) 555-77{i}3 or write" for i in range(10, 14)] + ["you may call 5557713x9 soon", "they call it a day", "we call them home", "we call us all", "some call me late", "others call him early"]
    texts += [f"it was m{i}@b{i}.org wrote this" for i in range(4)] + ["and bob(at)b9 wrote this"]
    texts += [f"seen by all but 10.0.0.{i} the" for i in range(4)] + [f"but {w} the" for w in prose(80).split()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert all(got[i] == 'say token = "<CONTEXT>" now' for i in range(4))
    assert got[8] == "you may call <CONTEXT> soon" and got[9] == texts[9]
    assert got[18] == "and <CONTEXT> wrote this" and all(got[i] == texts[i] for i in range(23, len(texts)))
    contexts = {r["pattern"] for r in pii.word_contexts(df, text_col="text").collect()}
    assert not contexts & {"left call", "left but", "right the"} and "left may call" in contexts


def test_html():
    page = "<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href=1>Home</a></nav><!-- x --><div class=ad>Buy now</div><article><h1>A &amp; B</h1><p>One&nbsp;two\n three<p><b>Four.<br><p></article><div id=comments><p>Nice page, I read all of it.</p></div><footer>Foot</footer></body></html>"
    assert html_blocks.main_text(page) == "A & B\nOne two three\nFour."
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<p") == html_blocks.main_text("<!-- open") == ""
    x, y = html_blocks.labelled_table()
    assert sum(a == (b == 1) for a, b in zip(html_blocks.decide(html_blocks.default_tree(), x), y, strict=True)) >= 0.99 * len(y)
    assert html_blocks.main_text("<article><p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hé</p></article>", "old"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_blocks.extraction_report(df).collect())) == [(1, "u", "Hé", 2), (2, None, "", 0)]
    assert html_blocks.extraction_report(df.limit(0)).count() == 0


def test_url_rules(spark):
    data = [(1, "http://A.Example.ORG/es/1", None), (2, "https://x.org/en/1", ""), (3, "http://q.com/de/9?x#y", '<link rel="canonical" href="http://far.net/1">'), (4, "http://far.net/1", ""), (5, "http://far.net/2", '<meta http-equiv="refresh" content="0; url=/1">'), (6, None, None), (7, "nothing", "x"), (8, "http://example.org/en/12", ""), (9, "http://g.net/a", '<link rel=canonical href=http://ok.org/b>'), (10, "http://ok.org/b", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["by"]) for r in url_rules.judge_urls(pages).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block", "rule")
    assert got[2][2:] == ("org/", "allow", "rule") and got[3][1:4] == ("/de/9", "com/de/", "block")
    assert got[4][2:] == got[5][2:] == (None, "block", "alias")
    assert got[6] == got[7] == ("", "", None, "allow", "default")
    assert got[8][2] == "example.org/en/1" and got[9][2:] == (None, "allow", "alias")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_licenses(spark, docs, rows):
    n, found = license_scan.scan_text("Some words.\nReleased under the MIT license.\nThe end, licensed by nobody in particular.")
    assert n == 2 and [(f["license"], f["start"]) for f in found] == [("MIT", 12)]
    assert license_scan.identify("This work is licensed under the GNU General Public License, version 2.")["license"] == "GPL-2.0"
    assert license_scan.identify("This work is licensed under the GNU General Public License, version 3.")["license"] == "GPL-3.0"
    assert license_scan.scan_text(None) == license_scan.scan_text("") == (0, [])
    assert license_scan.license_report(docs).count() == len(rows)


def test_licenses_over_lines_and_several_in_a_block():
    wrapped = {"BSD-3-Clause": "with or without", "MIT-grant": "obtaining a copy"}
    for name, at in wrapped.items():
        text = "Words before.\n" + license_scan.TEMPLATES[name].replace(at + " ", at + "\n") + "\nWords after."
        found = license_scan.scan_text(text)[1]
        assert [f["license"] for f in found] == [name] and text[found[0]["start"] :].startswith(license_scan.TEMPLATES[name][:20])
    both = "Licensed under the MIT License. Licensed under CC BY 4.0."
    assert [f["license"] for f in license_scan.scan_text(both)[1]] == ["MIT", "CC-BY-4.0"]
    names = ["GPL-2.0", "CC-BY-SA-4.0", "MIT", "AGPL-3.0", "MIT", "Apache-2.0-header", "LGPL-3.0", "CC0-1.0", "MPL-2.0", "BSD", "proprietary", "CC-BY-NC-4.0"]
    line = " some words here ".join(license_scan.TEMPLATES[n] for n in names)
    assert len(line) > 600 and [f["license"] for f in license_scan.scan_text(line)[1]] == names
    for name, t in license_scan.TEMPLATES.items():
        assert [(f["license"], f["start"], f["end"]) for f in license_scan.scan_text(f"Some words.\n{t}\nMore words.")[1]] == [(name, 12, 12 + len(t))]


def test_toxicity(spark, docs, rows, empty):
    rng = random.Random(2)
    texts = [(i, prose(60) + (" vilest rotter " if i % 3 == 0 else " ") + rng.choice(["women", "men", "pals"])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts[:240]] + [(0, 1), (None, 1), (999, None)], "doc_id long, toxic int")
    data = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(data, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(data, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    a, b = model.scores([b"the women here", b"the men here"])
    assert abs(a - b) < 0.05
    assert toxicity.score(docs, model).count() == len(rows) and toxicity.score(empty, model).count() == 0
    assert 0 < toxicity.train(empty, labels.limit(0)).scores([None])[0] < 1


def test_counterfactual_penalty_shrinks_identity_terms():
    women, rude = toxicity.hash_word("women"), toxicity.hash_word("rude")
    fill = [toxicity.hash_word(f"w{i}") for i in "abcdefgh"]
    bags = [np.unique(np.array([women, rude, fill[i % 8]])) for i in range(40)] + [np.unique(np.array([fill[i % 8], fill[(i + 1) % 8]])) for i in range(60)]
    y = np.array([1] * 40 + [0] * 60)

    def gap(p):
        a, b = toxicity.fit(bags, y, 0.4, penalty=p).scores([b"women", b"boys"])
        return abs(a - b)

    assert gap(50.0) < gap(0.0)


def test_language(spark, docs, rows, empty):
    rng = random.Random(4)
    sets = {"aa": ["kula", "mbari", "tanto"], "bb": ["strasse", "gruss", "schiff"], "cc": ["оченъ", "вода", "мир"]}
    data = [(i, " ".join(rng.choice(sets[k]) for _ in range(30)), k) for i in range(90) for k in [sorted(sets)[i % 3]]]
    filters = langid.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    names, score = filters.predict([b"kula tanto", b"gruss schiff", "вода мир".encode(), None, b"", b"123 !", b"x"])
    assert names[:6] == ["aa", "bb", "cc", "und", "und", "und"] and names[6] in sets
    assert ((0 <= score) & (score <= 1)).all()
    assert langid.identify(docs, filters).count() == len(rows) and langid.identify(empty, filters).count() == 0
    assert langid.train(empty).predict([b"abc"])[0] == ["und"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 100}
    assert connected_components(edges.limit(0)).where(F.lit(True)).count() == 0


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def group_mentions(seed, n, first=0):
    """Texts of which toxic ones mention a group far more often; toxic ones are also rude, most of them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = prose(40).split()
        if toxic and rng.random() < 0.8:
            words[5] = "vilest"
        if rng.random() < (0.7 if toxic else 0.05):
            words[9] = rng.choice(["women", "muslims"])
        out.append((first + i, " ".join(words), int(toxic)))
    return out


def test_penalty_reduces_false_positives_on_group_mentions(spark, tmp_path):
    data = spark.createDataFrame(group_mentions(1, 1500), "doc_id long, text string, toxic int")
    plain, fair = (toxicity.train(data.drop("toxic"), data.select("doc_id", "toxic"), penalty=p) for p in (0.0, 20.0))
    assert fair.twins > 100 and fair.change < 0.5 * plain.change
    neutral = [f"{prose(20)} {w} {prose(20)}".encode() for w in ("women", "muslims") for _ in range(100)]
    wrong = [int((m.scores(neutral) >= 0.5).sum()) for m in (plain, fair)]
    assert wrong[1] < 0.2 * wrong[0]
    folder = write_tables(spark, tmp_path, documents=data.drop("toxic"), labels=data.select("doc_id", "toxic", F.lit(1).alias("quality")))
    got = queries.op1_toxicity(spark, folder).join(data, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1500 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.85 * len(held)


def test_twins_without_identity_terms(spark):
    data = spark.createDataFrame([(i, prose(60) + (" vilest" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)], "doc_id long, text string, toxic int")
    model = toxicity.train(data.drop("toxic"), data.select("doc_id", "toxic"))
    assert model.twins > 0 and model.change < 0.05


def test_repeated_words_need_little_memory():
    block = decontaminate.Block([(1, b"a " * 4000), (2, b"a " * 3000), (3, b"b " * 5)])
    n_words, ranges, items, longest, place = decontaminate._search(pa.array(["a " * 20_000, "b b b b b b", None]), None, block)
    assert n_words.tolist() == [20_000, 6, 0] and ranges == [[0, 20_000], [0, 6], []] and items == [["1", "2"], ["3"], []]
    assert longest.tolist() == [4000, 5, 0] and place.tolist() == [0, 0, -1]


def test_longest_match_against_brute_force():
    rng = random.Random(12)
    for _ in range(150):
        letters = "abc"[: rng.randrange(1, 4)]
        items = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(30))).encode()) for i in range(rng.randrange(1, 5))]
        texts = [" ".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3)]
        texts[0] += " " + items[0][1].decode()
        found = decontaminate._search(pa.array(texts), None, decontaminate.Block(items, 4))
        for k, t in enumerate(texts):
            w, best = t.split(), (0, -1)
            for p in range(len(w)):
                for _, item in items:
                    x = item.decode().split()
                    for q in range(len(x)):
                        n = 0
                        while p + n < len(w) and q + n < len(x) and w[p + n] == x[q + n]:
                            n += 1
                        if n >= min(4, len(x)) and n > best[0]:
                            best = (n, p)
            assert (found[3][k], found[4][k]) == best


def test_three_hundred_languages(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(8)) for _ in range(6)] for i in range(300)}
    data = spark.createDataFrame([(i * 3 + k, " ".join(rng.choice(w) for _ in range(20)), name) for i, (name, w) in enumerate(own.items()) for k in range(3)] + [(None, "the same text here", "copies")] * 900, "doc_id long, text string, lang string")
    filters = langid.train(data, per_language=2, least=1)
    assert len(filters.languages) == 301
    names, _ = filters.predict([" ".join(w[:4]).encode() for w in own.values()] + [b"same text"])
    assert sum(a == b for a, b in zip(names, [*own, "copies"], strict=True)) >= 295


CLASHES = ("_k", "_p", "_at", "_m", "_g", "_z0", "z0", "_row", "_added", "mix", "model", "copies", "position", "base_spans", "of_row", "fingerprint", "rows", "seed")


def test_clashing_columns(spark, rows):
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    df = spark.createDataFrame([(*r[:5], *(f"{n}{i}" for n in CLASHES)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in CLASHES))
    want = {tuple(r[n] for n in ("doc_id", *CLASHES)) for r in df.collect()}
    for op in (quality.keep_good, simhash.one_of_each, pii.mask):
        got = op(df)
        assert got.columns == names and {tuple(r[n] for n in ("doc_id", *CLASHES)) for r in got.collect()} <= want
    got = mixing.training_order(df)
    assert got.columns == [*names, "copy", "taken", "position_1"]
    assert {tuple(r[n] for n in ("doc_id", *CLASHES)) for r in got.collect()} <= want


def test_positions_are_near_the_words_before(spark):
    rng = random.Random(6)
    data = spark.createDataFrame([(i, prose(rng.randrange(1, 60)), ["a", "a", "a", "b", "c", None][rng.randrange(6)]) for i in range(600)] + [(None, "just one text", "a")] * 300, "doc_id long, text string, source string").repartition(4)
    order = mixing.training_order(data).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and {r["copy"] for r in order} == {0, 1}
    before, sources, largest = 0, 4, 60
    for r in order:
        assert abs(r["position"] - before) <= sources * largest
        before += r["taken"]
    report = mixing.mixing_report(data).collect()
    assert before == sum(r["taken"] for r in report) == pytest.approx(sum({r["target"] for r in report}), abs=4)
    assert sum(r["taken"] for r in mixing.mixing_report(data, most=1.5).collect()) > 0
    again = mixing.mixing_report(data.repartition(7), slice_rows=5).collect()
    first = mixing.mixing_report(data, slice_rows=5).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, first))


def test_html_survives_bad_markup():
    long = "word and more of the story that goes on and on until the end of it all is near and then some "
    kept = {
        f"<body class='no-sidebar'><h1>T</h1><p>{long * 2}</p><p>{long}</p></body>": 3,
        f"<article class='entry has-comments'><h1>T</h1><p>Short one.</p><p>{long}</p></article>": 3,
        f"<p title='it's'>{long * 2}</p><p>{long} don't</p>": 2,
        f"<p data-x=don't>{long * 2}</p><p>{long} don't</p>": 2,
        f'<p title="x>{long * 2}</p><p class="y">{long * 2}</p>': 2,
        f"<p>{long * 2}</p><select><option>a<p>{long * 2}</p><p>{long * 2}</p>": 3,
        f"<form><nav><a href=x>a</a><article><h1>T</h1><p>{long}</p></article></form>": 2,
        f"<h1>Title of it</h1><p>{long * 2}</p><p>A short paragraph of only nine or ten words.</p><p>{long * 3}</p>": 4,
        f"<a href=x>home<li><a href=y>two</a><p>{long * 2}</p><a name=top><p>{long * 2}</p>": 2,
    }
    for page, n in kept.items():
        got = html_blocks.main_text(page).split("\n")
        assert sum(" ".join(long.split()) in x or x in ("T", "Short one.", "Title of it") or x.startswith("A short") for x in got) == n, page
    assert html_blocks.main_text("<article class=comment><p>I read it</p></article><div class=comments><article><p>Me too</p></article></div>") == ""


def test_html_tree_uses_counts_and_neighbours():
    def used(node):
        return set() if node.feature < 0 else {node.feature} | used(node.low) | used(node.high)

    assert used(html_blocks.default_tree()) >= {0, 1, 2, 4}  # words before, here and after; density here
    assert html_blocks.left_out_accuracy() >= 0.95


def test_alias_links(spark):
    assert url_rules.alias_targets("http://a.net/d/e.html?x", '<!-- <link rel=canonical href=/no> --><link rel="next canonical" href="f.html?p=1&amp;q=2"><LINK REL=canonical HREF=\'../up/\'><meta content="3; URL=?id=1" http-equiv=Refresh><link rel=canonical href="mailto:x">') == ["http://a.net/d/f.html?p=1&q=2", "http://a.net/up/", "http://a.net/d/e.html?id=1"]
    assert url_rules.alias_targets("http://a.net/", '<base href="http://b.net/c/"><link rel=canonical href=x>') == ["http://b.net/c/x"]
    data = [(1, "http://q.com/de/9", '<link rel=canonical href="http://x.net/a?p=1&amp;q=2">'), (2, "http://x.net/a?p=1&q=2", None), (3, "http://x.net/dir/b", '<link rel=canonical href="/other"><link rel=canonical href="../a?p=1&amp;q=2">'), (4, "http://x.net/other", ""), (5, "http://x.net/alone", "x")]
    data += [(10 + i, "http://x.net/other", None) for i in range(50)] + [(None, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = url_rules.judge_urls(pages).collect()
    assert len(got) == len(data) and all(r["verdict"] == ("allow" if r["page_id"] in (5, None) else "block") for r in got)


def test_url_sql_on_pages_with_links(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    hosts = ["a.net", "b.com", "x.example.org", "ok.org", "c.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'en', 'd'])}/{i}{rng.choice(['', '?p=1&q=2', '#f'])}" for i in range(60)]
    kinds = ['<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0;url={}'>", "<link href={} rel=canonical>", "<p>no link</p>", "<!-- <link rel=canonical href={}> -->"]
    targets = [u.replace("&", "&amp;") for u in urls] + ["/de/1", "../fr/2", "x/./y", "?id=3", "//a.net/de/4", "mailto:x", "#top"]
    data = [(i, u, "".join(rng.choice(kinds).format(rng.choice(targets)) for _ in range(rng.randrange(3)))) for i, u in enumerate(urls)] + [(99, None, None), (98, "no url", "<link rel=canonical href=/a>")]
    folder = write_tables(spark, tmp_path, pages=spark.createDataFrame(data, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op5_url_rules"])
    want = sorted(map(repr, ({c: v for c, v in zip(rel.columns, r, strict=True)} for r in rel.fetchall())))
    got = [r.asDict() for r in queries.op5_url_rules(spark, folder).collect()]
    assert sorted(repr({c: r[c] for c in rel.columns}) for r in got) == want and any(r["by"] == "alias" for r in got)


def brute_mcd(points, groups):
    """Kept flags by the same estimate in numpy, a group at a time."""
    p = len(quality.FLOORS)
    floors = np.array(quality.FLOORS)
    kept = np.ones(len(points), dtype=bool)

    def binned(d2):
        return np.floor(np.log2(d2 + 1e-3) * 32)

    def distance(x, centre, cov):
        off = x - centre
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)

    for g in sorted(set(groups)):
        mine = np.array([k == g for k in groups])
        x = points[mine]
        best = None
        for q in quality.STARTS:
            centre = np.percentile(x, 100 * q, axis=0)
            cov = np.diag(np.maximum(1.4826 * np.percentile(np.abs(x - centre), 50, axis=0), floors) ** 2)
            logdet = np.inf
            for _ in range(quality.STEPS):
                step = binned(distance(x, centre, cov))
                nearer = np.array([(step < s).sum() for s in step])
                inside = x[nearer < quality.SHARE * len(x)]
                new = inside.mean(axis=0), np.cov(inside.T, bias=True) + np.diag(floors**2)
                if np.linalg.slogdet(new[1])[1] < logdet:
                    (centre, cov), logdet = new, np.linalg.slogdet(new[1])[1]
            if best is None or logdet < best[0]:
                best = logdet, centre, cov
        step = binned(distance(x, *best[1:]))
        scale = max(1.0, 2 ** (np.percentile(step, 50) / 32) / quality._median_chi2(p))
        kept[mine] = distance(x, *best[1:]) / scale <= quality.chi2_cutoff(quality.LEVEL, p)
    return kept


def test_kept_against_brute_force(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice(VOCABULARY) + str(rng.randrange(300)) + ("#" * rng.randrange(9) if i % 17 == 0 else "") for _ in range(rng.randrange(50, 400))) for i in range(360)]
    data = [(i, t, ["en", "de"][i % 2], ["s", "t"][i % 3 == 0]) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.quality_report(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    rows = [got[i] for i in range(len(data))]
    n, chars = np.array([r["n_words"] for r in rows], float), np.array([r["word_chars"] for r in rows], float)
    sym, dup, rep = (np.array([r[c] for r in rows], float) for c in ("n_symbols", "n_dup_lines", "n_repeat_words"))
    points = np.stack([np.log(n), np.log(chars / n), np.sqrt(sym / chars), np.sqrt(20 * dup / n), np.sqrt(rep / n)], axis=1)
    points = np.floor(points * quality.GRID + 0.5) / quality.GRID
    want = brute_mcd(points, [d[2:] for d in data])
    assert [r["kept"] for r in rows] == [bool(k) and not r["base_failed"] for k, r in zip(want, rows, strict=True)]
    assert 0 < sum(not r["kept"] for r in rows) < 40


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    w = prose(400).split()
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(900, " ".join(w), "en", "s9", 1), (901, prose(200) + " mail me@here.org now", "en", "s1", 1), (902, prose(200) + " mail me@here.org now", "en", "s1", 1)]
    documents = plain.unionByName(spark.createDataFrame(more, plain.schema))
    bench = spark.createDataFrame([(1, " ".join(w[50:120])), (2, None)], "item_id long, text string")
    folder = write_tables(spark, tmp_path, documents=documents, benchmark=bench)
    got = pipeline.run(spark, folder).collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    # stages can follow one another without a table between them
    lazily = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        lazily = stage(spark, lazily, folder)
        assert name == "mixing" or lazily.columns == documents.columns
    assert {(r["doc_id"], r["copy"], r["taken"]) for r in lazily.collect()} == {(r["doc_id"], r["copy"], r["taken"]) for r in got}
    ids = {r["doc_id"] for r in got}
    assert 900 not in ids and 901 in ids and not any("@" in r["text"] for r in got)
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_report(documents).collect()}
    assert all(judged[i] for i in ids) and len(ids & {0, 1}) == 1
    parts = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(documents.where(F.col("doc_id").isin(sorted(ids)))).collect()}
    assert all(parts[i] == i for i in ids)
    empty = write_tables(spark, tmp_path, documents=documents.limit(0), benchmark=bench.limit(0))
    assert pipeline.run(spark, empty).count() == 0
